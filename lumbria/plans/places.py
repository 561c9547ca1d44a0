"""Spatial operators over customers and suppliers, to whom places are given by arithmetic on their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import density as de, entities as en, joins as j

_LAT, _LON = "-18 + (({k} * 7919) % 16000) / 1000.0D", "-81 + (({k} * 104729) % 12000) / 1000.0D"


def places(spark: SparkSession, sf: str, table: str, key: str, extra: tuple[str, ...] = ()) -> DataFrame:
    t = spark.read.parquet(f"{sf}/{table}.parquet")
    return t.select(F.col(key).alias("id"), F.expr(_LAT.format(k=key)).alias("lat"), F.expr(_LON.format(k=key)).alias("lon"), F.expr(f"CAST(({key} * 31) % 4500 AS DOUBLE)").alias("alt"), *extra)


def customers(s, d):
    return places(s, d, "customer", "c_custkey", ("c_nationkey", "c_name", "c_mktsegment"))


def suppliers(s, d):
    return places(s, d, "supplier", "s_suppkey", ("s_nationkey", "s_name")).withColumnsRenamed({"id": "s_id", "alt": "s_alt"})


_SQL = "WITH c AS (SELECT c_custkey AS id, " + (_LAT.format(k="c_custkey") + " AS lat, " + _LON.format(k="c_custkey") + " AS lon, ").replace("0D", "0::DOUBLE") + "CAST((c_custkey * 31) % 4500 AS DOUBLE) AS alt, c_nationkey, c_name, c_mktsegment FROM customer), s AS (SELECT s_suppkey AS s_id, " + (_LAT.format(k="s_suppkey") + " AS r_lat, " + _LON.format(k="s_suppkey") + " AS r_lon, ").replace("0D", "0::DOUBLE") + "CAST((s_suppkey * 31) % 4500 AS DOUBLE) AS s_alt, s_nationkey, s_name FROM supplier)"
_SQL = _SQL.replace(".0::DOUBLE", "::DOUBLE")


def _hav(a: str, b: str, c: str, d: str, r: float = 6371.0) -> str:
    return f"(2 * {r} * asin(least(1.0, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


_D = _hav("c.lat", "c.lon", "s.r_lat", "s.r_lon")
_NEAR = lambda km, k: f"{_SQL}, p AS (SELECT c.id, s.s_id, {_D} AS km FROM c, s), q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, s_id) AS place FROM p WHERE km <= {km}) SELECT id, s_id, CAST(place AS INT) AS place, round(km, 6) AS km FROM q WHERE place <= {k}"

_WORDS = "list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')"


def _components(s: SparkSession, d: str) -> DataFrame:
    return de.radius_components(suppliers(s, d).withColumnRenamed("s_id", "id").select("id", "lat", "lon"), 120)


def _entities(s: SparkSession, d: str) -> DataFrame:
    """Two sources of places: equal words within 60 km, or half of the words shared within 25 km; best partner each."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    a = customers(s, d).select("id", "lat", "lon", words(F.concat_ws(" ", "c_mktsegment", F.lit("place"), (F.col("id") % 7).cast("string"))).alias("w"))
    b = suppliers(s, d).select("s_id", "lat", "lon", words(F.concat_ws(" ", F.lit("machinery"), F.lit("place"), (F.col("s_id") % 7).cast("string"))).alias("w"))
    return en.entities(a, b, "w", 60, 0.5, 25)


_OWN = lambda c, key: f"(SELECT list_distinct(string_split(lower({c}), ' ')))"

QUERIES = {
    "J7_radius_join": (lambda s, d: j.radius_join(customers(s, d), suppliers(s, d), 50).select("id", "s_id", F.round("km", 6).alias("km")), f"{_SQL} SELECT c.id, s.s_id, round({_D}, 6) AS km FROM c, s WHERE {_D} <= 50"),
    "J8_nearest": (lambda s, d: j.nearest(customers(s, d), suppliers(s, d), ["id"], ["s_id"], 300, 3).select("id", "s_id", "place", F.round("km", 6).alias("km")), _NEAR(300, 3)),
    "J9_group_median": (lambda s, d: j.distance_to_group_median(customers(s, d), "c_nationkey", "id", "lat", "lon").select("id", F.round("km", 6).alias("km")), f"{_SQL}, m AS (SELECT a.id, a.lat, a.lon, quantile_cont(b.lat, 0.5) AS la, quantile_cont(b.lon, 0.5) AS lo FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey AND a.id <> b.id GROUP BY ALL) SELECT id, round({_hav('lat', 'lon', 'la', 'lo')}, 6) AS km FROM m"),
    "J10_pairs": (lambda s, d: j.pairs_within(suppliers(s, d).withColumnRenamed("s_id", "id"), ["s_nationkey"], "id", ["lat", "lon"]).select("s_nationkey", "id", "r_id", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")), 6).alias("km")), f"{_SQL} SELECT a.s_nationkey, a.s_id AS id, b.s_id AS r_id, round({_hav('a.r_lat', 'a.r_lon', 'b.r_lat', 'b.r_lon')}, 6) AS km FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_id < b.s_id"),
    "J13_two_legs": (
        lambda s, d: j.best_two_legs(
            suppliers(s, d).select("s_id", F.col("s_nationkey").alias("a"), F.col("s_alt").alias("cost")),
            s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"), (F.col("n_nationkey") * 11 % 90 + 40).cast("double").alias("cost")),
            s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("b"), F.col("s_suppkey").alias("t_id"), F.expr("CAST(s_suppkey * 17 % 300 AS DOUBLE)").alias("cost")), "s_id", "t_id", ("a", "b")),
        f"{_SQL}, m AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b, CAST(n_nationkey * 11 % 90 + 40 AS DOUBLE) AS c2 FROM nation), l AS (SELECT s_nationkey AS b, s_suppkey AS t_id, CAST(s_suppkey * 17 % 300 AS DOUBLE) AS c3 FROM supplier), p AS (SELECT s.s_id, l.t_id, s.s_alt + c2 + c3 AS total, m.a, m.b FROM s JOIN m ON s.s_nationkey = m.a JOIN l ON m.b = l.b) SELECT s_id, t_id, x[1] AS total, CAST(x[2] AS INT) AS a, CAST(x[3] AS INT) AS b FROM (SELECT s_id, t_id, min([total, a, b]) AS x FROM p GROUP BY ALL)"),
    "J17_entities": (_entities, f"{_SQL}, a AS (SELECT id, lat, lon, list_distinct(string_split(lower(c_mktsegment || ' place ' || CAST(id % 7 AS VARCHAR)), ' ')) AS w FROM c), b AS (SELECT s_id, r_lat, r_lon, list_distinct(string_split('machinery place ' || CAST(s_id % 7 AS VARCHAR), ' ')) AS rw FROM s), p AS (SELECT id, s_id, {_hav('lat', 'lon', 'r_lat', 'r_lon')} AS km, len(list_intersect(w, rw)) / len(list_distinct(list_concat(w, rw))) AS jac FROM a, b), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY jac DESC, km, s_id) AS r FROM p WHERE km <= 60 AND (jac = 1 OR (jac >= 0.5 AND km <= 25))) SELECT id, s_id, jac AS jaccard FROM o WHERE r = 1"),
    "F18_haversine": (lambda s, d: customers(s, d).select("id", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(-12.05), F.lit(-77.04)), 6).alias("km"), F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(-12.05), F.lit(-77.04), geo.RADIUS_KM_FINE) * 1000, 3).alias("m")), f"{_SQL} SELECT id, round({_hav('lat', 'lon', '-12.05', '-77.04')}, 6) AS km, round({_hav('lat', 'lon', '-12.05', '-77.04', 6371.0088)} * 1000, 3) AS m FROM c"),
    "F19_effective_km": (lambda s, d: customers(s, d).select("id", F.round(geo.effective_km(F.col("alt") / 10, F.when(F.col("id") % 5 > 0, F.col("alt") - 2000)), 6).alias("km")), f"{_SQL} SELECT id, round(sqrt(pow(alt / 10, 2) + pow(coalesce(CASE WHEN id % 5 > 0 THEN abs(alt - 2000) END, 0) * 0.06, 2)), 6) AS km FROM c"),
    "F20_bearing": (lambda s, d: customers(s, d).select("id", F.round(geo.bearing_deg(F.col("lat"), F.col("lon"), F.lit(-12.05), F.lit(-77.04)), 6).alias("deg"), F.round(geo.m_of_chord(geo.chord_of_m(F.col("alt"))), 4).alias("m")), f"{_SQL}, b AS (SELECT id, alt, degrees(atan2(sin(radians(-77.04 - lon)) * cos(radians(-12.05)), cos(radians(lat)) * sin(radians(-12.05)) - sin(radians(lat)) * cos(radians(-12.05)) * cos(radians(-77.04 - lon)))) AS g FROM c) SELECT id, round(CASE WHEN g < 0 THEN g + 360 ELSE g END, 6) AS deg, round(alt, 4) AS m FROM b"),
    "F21_satellite_grid": (lambda s, d: customers(s, d).select("id", geo.goes_xy(F.col("lat"), F.col("lon")).alias("g")).select("id", F.round("g.x", 9).alias("x"), F.round("g.y", 9).alias("y")), f"{_SQL}, g AS (SELECT id, atan(6356752.31414::DOUBLE * 6356752.31414::DOUBLE / (6378137.0::DOUBLE * 6378137.0::DOUBLE) * tan(radians(lat))) AS c, radians(lon + 75.0) AS d FROM c), r AS (SELECT *, 6356752.31414::DOUBLE / sqrt(1 - (6378137.0::DOUBLE * 6378137.0::DOUBLE - 6356752.31414::DOUBLE * 6356752.31414::DOUBLE) / (6378137.0::DOUBLE * 6378137.0::DOUBLE) * cos(c) * cos(c)) AS r FROM g), v AS (SELECT id, 42164160.0::DOUBLE - r * cos(c) * cos(d) AS sx, -r * cos(c) * sin(d) AS sy, r * sin(c) AS sz FROM r) SELECT id, round(asin(-sy / sqrt(sx * sx + sy * sy + sz * sz)), 9) AS x, round(atan2(sz, sx), 9) AS y FROM v"),
    "P8_bounding_box": (lambda s, d: customers(s, d).where(geo.in_box(F.col("lat"), F.col("lon"), -14, -10, -78, -74, 0.5)).select("id", "lat", "lon"), f"{_SQL} SELECT id, lat, lon FROM c WHERE lat BETWEEN -14.5 AND -9.5 AND lon BETWEEN -78.5 AND -73.5"),
    "S18_cells": (lambda s, d: customers(s, d).select(F.explode(F.array(*(F.struct(F.floor(F.col("lat") + a).cast("int").alias("y"), F.floor(F.col("lon") + b).cast("int").alias("x")) for a in (-0.1, 0.1) for b in (-0.1, 0.1)))).alias("c")).groupBy("c.y", "c.x").agg(F.count(F.lit(1)).alias("n")), f"{_SQL}, m AS (SELECT unnest([-0.1, 0.1]) AS a) SELECT CAST(floor(lat + p.a) AS INT) AS y, CAST(floor(lon + q.a) AS INT) AS x, count(*) AS n FROM c, m p, m q GROUP BY 1, 2"),
    "G5_components": (_components, f"{_SQL}, RECURSIVE_E AS (SELECT a.s_id AS a, b.s_id AS b FROM s a, s b WHERE {_hav('a.r_lat', 'a.r_lon', 'b.r_lat', 'b.r_lon')} <= 120), x AS (SELECT s_id AS node, s_id AS component FROM s) SELECT * FROM x".replace("WITH c AS", "WITH RECURSIVE c AS").replace("RECURSIVE_E", "e").replace(", x AS (SELECT s_id AS node, s_id AS component FROM s) SELECT * FROM x", ", t(node, r) AS (SELECT s_id, s_id FROM s UNION SELECT t.node, e.b FROM t JOIN e ON t.r = e.a) SELECT node, min(r) AS component FROM t GROUP BY node")),
}
