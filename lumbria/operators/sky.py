"""The night sky: light that reaches a place, clear nights by month, sun and moon, hours of darkness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import nearest


def brightness(cells: DataFrame, dx_km: float, dy_km: float, reach_km: float, scale: float, least: float = 0.0, row: str = "row", col: str = "col", light: str = "light") -> DataFrame:
    """(row, col, sky): light of all cells within reach_km, each times d ** -(2.3 * (d / 350) ** 0.28), times scale.

    Only lit cells spread, each to the cells of its own bounded surrounding; the sums are pre-aggregated before they
    move. Cells that nothing reaches are absent. A cell is a quarter of its width away from itself.
    """
    ny, nx = int(reach_km / dy_km) + 1, int(reach_km / dx_km) + 1
    lit = cells.where((F.col(light) >= least) & (F.col(light) > 0))
    spread = lit.select(F.col(row).alias("_r"), F.col(col).alias("_c"), F.col(light).alias("_l"), F.explode(F.sequence(F.lit(-ny), F.lit(ny))).alias("_y")).withColumn("_x", F.explode(F.sequence(F.lit(-nx), F.lit(nx))))
    d = F.greatest(F.hypot(F.col("_x") * dx_km, F.col("_y") * dy_km), F.lit(dx_km / 4))
    weight = F.pow(d, -(2.3 * F.pow(d / 350.0, F.lit(0.28)))) * (dx_km * dy_km * scale)
    out = spread.withColumn("_d", d).where(F.col("_d") <= reach_km).groupBy((F.col("_r") + F.col("_y")).alias(row), (F.col("_c") + F.col("_x")).alias(col)).agg(F.sum(F.col("_l") * weight).alias("sky"))
    return out.join(cells.select(row, col), [row, col], "left_semi")


def clear_share(points: DataFrame, cells: DataFrame, key: str = "id") -> DataFrame:
    """(key, month, share): of the good observations in the three by three cells around a point, those with a clear sky;
    null without any. points: (key, row, col); cells: (row, col, month, clear, valid)."""
    around = points.select(key, F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("row"), "col").select(key, "row", F.explode(F.sequence(F.col("col") - 1, F.col("col") + 1)).alias("col"))
    n = around.join(cells, ["row", "col"]).groupBy(key, "month").agg(F.sum("clear").alias("_c"), F.sum("valid").alias("_v"))
    return n.select(key, "month", F.round(F.try_divide(F.col("_c") * 1.0, F.col("_v")), 3).alias("share"))


def coast_fallback(points: DataFrame, satellite: DataFrame, airports: DataFrame, observed: DataFrame, coast_km: float, below_m: float, km: float = 150.0) -> DataFrame:
    """(id, month, share, source): satellite's share, but for low places by the sea that of the nearest airport within km,
    and nothing where there is none. points: (id, lat, lon, altitude, sea_km); airports: (airport, r_lat, r_lon)."""
    coastal = (F.col("sea_km") <= coast_km) & (F.col("altitude").isNull() | (F.col("altitude") < below_m))
    inland = points.where(~coastal).select("id").join(satellite, "id").select("id", "month", "share", F.lit("satellite").alias("source"))
    at = nearest(points.where(coastal), airports.select("airport", F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon")), ["id"], ["airport"], km)
    return inland.unionByName(at.select("id", "airport").join(observed, "airport").select("id", "month", "share", F.lit("airport").alias("source")))


def clear_nights(reports: DataFrame, hours: tuple[int, ...] = (2, 6), most_min: int = 30) -> DataFrame:
    """(station, day, hour, clear) from airport reports (station, at, report): per day and hour the report nearest to the
    full hour, half an hour off at most; clear if it has no cloud layer above FEW. Reports that don't say are left out."""
    layers = F.regexp_extract_all("report", F.lit(r"\b(FEW|SCT|BKN|OVC|VV)(\d{3}|///)"), F.lit(1))
    says = (F.size(layers) > 0) | F.col("report").rlike(r"\b(CLR|SKC|NSC|NCD|CAVOK)\b")
    minute = F.hour("at") * 60 + F.minute("at")
    r = reports.where(says).withColumn("clear", F.forall(layers, lambda x: x == "FEW")).withColumn("hour", F.explode(F.array(*map(F.lit, hours))))
    r = r.withColumn("_off", F.abs(minute - F.col("hour") * 60)).where(F.col("_off") <= most_min).withColumn("day", F.to_date("at"))
    w = Window.partitionBy("station", "day", "hour").orderBy("_off", "at", "report")
    return r.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("station", "day", "hour", "clear")


def _days(at: Column) -> Column:
    """Days since 1 January 2000, noon."""
    return F.unix_micros(at) / 86_400_000_000 - 10957.5


_sin = lambda deg: F.sin(F.radians(deg))
_cos = lambda deg: F.cos(F.radians(deg))


def _altitude(longitude: Column, latitude: Column, d: Column, lat: Column, lon: Column) -> Column:
    """Degrees above the horizon of what stands at these ecliptic coordinates."""
    tilt = F.lit(23.439) - d * 0.0000004
    declination = F.asin(_sin(latitude) * _cos(tilt) + _cos(latitude) * _sin(tilt) * _sin(longitude))
    ascension = F.degrees(F.atan2(_sin(longitude) * _cos(tilt) - F.tan(F.radians(latitude)) * _sin(tilt), _cos(longitude)))
    hour = F.lit(280.46062) + d * 360.98564737 + lon - ascension
    return F.degrees(F.asin(_sin(lat) * F.sin(declination) + _cos(lat) * F.cos(declination) * _cos(hour)))


def sun_longitude(d: Column) -> Column:
    g = F.lit(357.528) + d * 0.9856003
    return F.lit(280.460) + d * 0.9856474 + _sin(g) * 1.915 + _sin(g * 2) * 0.020


def moon_place(d: Column) -> tuple[Column, Column]:
    """Ecliptic longitude and latitude to about half a degree."""
    anomaly, node = F.lit(134.963) + d * 13.064993, F.lit(93.272) + d * 13.229350
    elongation, sun = F.lit(297.850) + d * 12.190749, F.lit(357.528) + d * 0.9856003
    turn = _sin(elongation * 2 - anomaly) * 1.274 + _sin(elongation * 2) * 0.658 - _sin(sun) * 0.186
    return F.lit(218.316) + d * 13.176396 + _sin(anomaly) * 6.289 + turn, _sin(node) * 5.128


def sun_altitude(at: Column, lat: Column, lon: Column) -> Column:
    """Degrees; low-precision almanac formulas, good to a hundredth."""
    d = _days(at)
    return _altitude(sun_longitude(d), F.lit(0.0), d, lat, lon)


def moon_altitude(at: Column, lat: Column, lon: Column) -> Column:
    """Degrees, to about one: parallax is left out."""
    d = _days(at)
    return _altitude(*moon_place(d), d, lat, lon)


def moon_light(at: Column) -> Column:
    """Illuminated share of the moon, 0 to 1."""
    d = _days(at)
    longitude, latitude = moon_place(d)
    return (1 - _cos(latitude) * _cos(longitude - sun_longitude(d))) / 2


def dark_hours(nights: DataFrame, sun_below: float = -18.0, step_min: int = 5) -> DataFrame:
    """nights (id, lat, lon, night) with dark_hours: from noon to noon local solar time, in steps, those with the sun at
    least 18 degrees down and the moon below the horizon; and moon, the moon's light at the middle of the night."""
    n = 24 * 60 // step_min
    noon = F.timestamp_micros(F.unix_micros(F.col("night").cast("timestamp")) + ((12 - F.col("lon") / 15) * 3_600_000_000).cast("long"))
    steps = nights.withColumn("_noon", noon).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.timestamp_micros(F.unix_micros("_noon") + F.col("_k").cast("long") * (step_min * 60_000_000))
    lat, lon = F.col("lat"), F.col("lon")
    dark = (sun_altitude(at, lat, lon) <= sun_below) & (moon_altitude(at, lat, lon) < 0)
    out = steps.groupBy("id", "lat", "lon", "night", "_noon").agg((F.count_if(dark) * (step_min / 60)).alias("dark_hours"))
    return out.withColumn("moon", moon_light(F.timestamp_micros(F.unix_micros("_noon") + 43_200_000_000))).drop("_noon")


def new_moons(days: DataFrame, day: str = "day") -> DataFrame:
    """Days of a gapless calendar on which the moon is darkest: less light at their noon than on the days beside them."""
    light = moon_light(F.timestamp_micros(F.unix_micros(F.col(day).cast("timestamp")) + 43_200_000_000))
    near = F.transform(F.expr("array(-1, 1)"), lambda k: moon_light(F.timestamp_micros(F.unix_micros(F.col(day).cast("timestamp")) + 43_200_000_000 + k.cast("long") * 86_400_000_000)))
    return days.where(light < F.array_min(near)).withColumn("light", light)


def km_a_cell(degrees: float, latitude: float) -> tuple[float, float]:
    """East-west and north-south size of a cell in kilometres."""
    return degrees * 111.320 * math.cos(math.radians(latitude)), degrees * 110.574
