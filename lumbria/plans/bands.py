"""Bands, nested places and sessions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands as b
from ..session import scratch
from ..sources import files
from ..streaming import log as st
from .relational import T

c = F.col
KINDS = ["part of promo", "part of small"]


def _bands(s: SparkSession, d: str) -> DataFrame:
    k = c("o_orderkey")
    km, km2, light = F.when(k % 11 > 0, k % 2300), F.when(k % 13 > 0, k % 600), F.when(k % 17 > 0, c("o_custkey") % 40 / 10)
    return T(s, d, "orders").select("o_orderkey", b.range_label(km, b.WAY_KM).alias("way"), b.town_band(km2).alias("town"), b.sky_class(light).alias("sky"), b.band(km, (10, 100), from_edge=False).alias("below"))


_BANDS = """SELECT o_orderkey, CASE WHEN km > 0 AND km <= 10 THEN '0-10 km' WHEN km > 10 AND km <= 30 THEN '10-30 km' WHEN km > 30 AND km <= 100 THEN '30-100 km' WHEN km > 100 AND km <= 300 THEN '100-300 km' WHEN km > 300 AND km <= 2000 THEN '300-2000 km' END AS way,
CAST(CASE WHEN km2 >= 500 THEN 3 WHEN km2 >= 100 THEN 2 WHEN km2 >= 20 THEN 1 ELSE 0 END AS INT) AS town, CASE WHEN light < 0.3 THEN 'very dark' WHEN light < 2 THEN 'dark' WHEN light >= 2 THEN 'lit' END AS sky, CAST(CASE WHEN km > 100 THEN 2 WHEN km > 10 THEN 1 WHEN km >= 0 THEN 0 END AS INT) AS below
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 2300 END AS km, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 600 END AS km2, CASE WHEN o_orderkey % 17 > 0 THEN (o_custkey % 40) / 10::DOUBLE END AS light FROM orders)"""


def places(s: SparkSession, d: str) -> str:
    """All parts as places in the nested layout; the path they are written to."""
    k, path = c("p_partkey"), scratch(s, "places")
    source = lambda n, lic: F.struct(F.lit(n).alias("dataset"), lic.alias("license"), k.cast("string").alias("record"))
    licence = F.when(k % 5 == 0, "ODbL-1.0").when(k % 7 == 0, F.lit(None).cast("string")).otherwise("CDLA-Permissive-2.0")
    lon, lat = (-81 + k % 130 / 10), (-18 + k % 170 / 10)
    rows = T(s, d, "part").select(
        k.cast("string").alias("id"), F.struct(c("p_name").alias("primary"), F.create_map(F.lit("es"), c("p_name")).alias("common")).alias("names"), F.concat(F.lit("part of "), F.lower(F.element_at(F.split("p_type", " "), -1))).alias("kind"),
        F.when(k % 9 > 0, k % 100 / 100).alias("confidence"), F.struct(lon.alias("xmin"), lon.alias("xmax"), lat.alias("ymin"), lat.alias("ymax")).alias("bbox"),
        F.when(k % 11 == 0, F.array().cast("array<struct<dataset:string,license:string,record:string>>")).when(k % 3 == 0, F.array(source("a", F.lit("CDLA-Permissive-2.0")), source("b", licence))).otherwise(F.array(source("a", licence))).alias("sources"),
    )
    rows.write.parquet(path)
    return path


_PLACES = """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, 'part of ' || lower(string_split(p_type, ' ')[-1]) AS kind, round(-18 + (p_partkey % 170) / 10::DOUBLE, 6) AS lat, round(-81 + (p_partkey % 130) / 10::DOUBLE, 6) AS lon
FROM part WHERE lower(string_split(p_type, ' ')[-1]) IN ('promo', 'small') AND p_partkey % 9 > 0 AND p_partkey % 100 >= 70 AND p_partkey % 11 > 0 AND p_partkey % 5 > 0 AND p_partkey % 7 > 0"""


def _places(s: SparkSession, d: str) -> DataFrame:
    return files.read_places(s, places(s, d), KINDS).select("id", "name", "kind", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _plain(df: DataFrame) -> DataFrame:
    return df.select("user_id", c("starts").cast("timestamp_ntz").alias("starts"), c("ends").cast("timestamp_ntz").alias("ends"), "n")


def _log(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "events").select("user_id", c("ts").cast("timestamp").alias("ts"))


_E = "e AS (SELECT user_id, date_trunc('microsecond', ts) AS ts FROM events WHERE user_id IS NOT NULL)"

QUERIES = {
    "P17_bands": (_bands, _BANDS),
    "S5_nested_places": (_places, _PLACES),
    "ST7_sessions": (lambda s, d: _plain(st.by_session(_log(s, d), "user_id", "ts")), f"WITH {_E} SELECT user_id, min(ts) AS starts, max(ts) AS ends, count(*) AS n FROM e GROUP BY user_id"),
    "ST7_by_pause": (lambda s, d: _plain(st.run_once(st.by_pause(st.landed(_log(s, d), "log"), "user_id", "ts"), "pauses", "complete")), f"WITH {_E}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS starts, max(ts) AS ends, count(*) AS n FROM h GROUP BY user_id, k"),
}
