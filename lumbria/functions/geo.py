"""Geometry as column expressions. Degrees in, kilometres or metres out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radii in km: rounded, and as the geodetic union has it.
RADIUS_KM, RADIUS_KM_FINE = 6371.0, 6371.0088
#: Kilometres of effort that a metre of height difference adds.
CLIMB_KM_PER_M = 0.06
#: GOES fixed grid: equatorial and polar radius, satellite distance from the Earth's centre, in m, and its longitude.
GOES = {"a": 6378137.0, "b": 6356752.31414, "h": 42164160.0, "lon": -75.0}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_KM) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def effective_km(km: Column, climb_m: Column) -> Column:
    """Distance and height difference as one: the root of their squares' sum; an unknown difference is none."""
    up = F.coalesce(F.abs(climb_m), F.lit(0.0)) * F.lit(CLIMB_KM_PER_M)
    return F.sqrt(km * km + up * up)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360, north 0."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(deg + F.lit(360.0), F.lit(360.0))


def unit_vector(lat: Column, lon: Column) -> Column:
    a, o = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(a) * F.cos(o)).alias("x"), (F.cos(a) * F.sin(o)).alias("y"), F.sin(a).alias("z"))


def chord_of_m(metres: Column, radius: float = RADIUS_KM_FINE) -> Column:
    """Straight distance between two points of the unit sphere that lie so many metres apart on the ground."""
    return F.lit(2.0) * F.sin(metres / F.lit(2000.0 * radius))


def m_of_chord(chord: Column, radius: float = RADIUS_KM_FINE) -> Column:
    return F.lit(2000.0 * radius) * F.asin(F.least(F.lit(1.0), chord / 2))


def goes_xy(lat: Column, lon: Column) -> Column:
    """Scan angles (x, y) in radians of a point as the satellite sees it."""
    a, b, h = GOES["a"], GOES["b"], GOES["h"]
    e2 = (a * a - b * b) / (a * a)
    c = F.atan(F.lit(b * b / (a * a)) * F.tan(F.radians(lat)))
    r = F.lit(b) / F.sqrt(F.lit(1.0) - F.lit(e2) * F.cos(c) * F.cos(c))
    d = F.radians(lon - F.lit(GOES["lon"]))
    sx = F.lit(h) - r * F.cos(c) * F.cos(d)
    sy = -r * F.cos(c) * F.sin(d)
    sz = r * F.sin(c)
    return F.struct(F.asin(-sy / F.sqrt(sx * sx + sy * sy + sz * sz)).alias("x"), F.atan2(sz, sx).alias("y"))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float, margin: float = 0.0) -> Column:
    return lat.between(south - margin, north + margin) & lon.between(west - margin, east + margin)
