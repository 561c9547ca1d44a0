"""Nights of trips that the orders make, in zones with shows that the suppliers make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nights as ni
from .relational import T

c = F.col


def tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(trips, zones, shows, dark) as night_plans() takes them."""
    k = c("o_orderkey")
    o = T(s, d, "orders")
    trips = o.select(
        k.alias("trip"), (c("o_custkey") % 50).alias("zone"), (1 + k % 2).cast("int").alias("arrives"), (1 + k % 2 + k % 6).cast("int").alias("leaves"), F.when(k % 3 > 0, c("o_orderdate").cast("date")).alias("start"),
        (k % 2 == 0).alias("out"), (k % 5 < 3).alias("stars"), (k % 7 < 3).alias("high"),
    )
    z = c("zone")
    zones = T(s, d, "customer").select((c("c_custkey") % 50).alias("zone")).distinct().select("zone", (z % 4 > 0).alias("venues"), F.when(z % 5 > 0, (z % 10) / 10).alias("clear"))
    p = c("s_suppkey")
    shows = T(s, d, "supplier").select((p % 50).alias("zone"), p.alias("id"), (p * 7 % 90).alias("minutes"), F.when(p % 3 > 0, F.array((p % 7).cast("int"), ((p + 2) % 7).cast("int"))).alias("days"))
    days = o.select(F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"), (c("o_custkey") % 50).alias("zone"), c("o_orderdate").cast("date").alias("start")).select("zone", F.date_add("start", c("k")).alias("day")).distinct()
    dark = days.withColumn("hours", ((F.unix_date("day") * 7 + z) % 11).cast("double"))
    return trips, zones, shows, dark


_SQL = """WITH t AS (SELECT o_orderkey AS trip, o_custkey % 50 AS zone, 1 + o_orderkey % 2 AS a, 1 + o_orderkey % 2 + o_orderkey % 6 AS l, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS start, o_orderkey % 2 = 0 AS out_, o_orderkey % 5 < 3 AS stars, o_orderkey % 7 < 3 AS high FROM orders),
z AS (SELECT DISTINCT c_custkey % 50 AS zone FROM customer),
s AS (SELECT zone, arg_min(id, minutes * 1000000 + id) AS id, arg_min(days, minutes * 1000000 + id) AS days FROM (SELECT s_suppkey % 50 AS zone, s_suppkey AS id, s_suppkey * 7 % 90 AS minutes, CASE WHEN s_suppkey % 3 > 0 THEN [s_suppkey % 7, (s_suppkey + 2) % 7] ELSE [-1] END AS days FROM supplier) WHERE minutes <= 60 GROUP BY zone),
u AS (SELECT t.*, coalesce(out_ AND z.zone IS NOT NULL AND t.zone % 4 > 0, false) AS goes, stars AND (t.zone % 5 = 0 OR z.zone IS NULL OR t.zone % 10 / 10::DOUBLE >= 0.4) AS sky, s.id, s.days FROM t LEFT JOIN z USING (zone) LEFT JOIN s USING (zone)),
n AS (SELECT *, unnest(range(a, l)) AS night FROM u WHERE l > a),
f AS (SELECT *, goes AND high AND night = a AS rest FROM n),
g AS (SELECT trip, min(night) AS f0, count(*) AS k, min(CASE WHEN night > a THEN night END) AS f1, min(CASE WHEN list_contains(days, isodow(start + CAST(night - 1 AS INT)) - 1) THEN night END) AS plays, any_value(a) AS a FROM f WHERE NOT rest GROUP BY trip),
h AS (SELECT f.*, CASE WHEN id IS NULL THEN NULL WHEN start IS NOT NULL AND days <> [-1] THEN g.plays WHEN g.k > 1 AND g.f0 = f.a THEN g.f1 ELSE g.f0 END AS at_show FROM f LEFT JOIN g USING (trip)),
i AS (SELECT *, rest OR coalesce(night = at_show, false) AS used FROM h),
j AS (SELECT *, count(*) FILTER (NOT used) OVER (PARTITION BY trip) AS free FROM i),
m AS (SELECT trip, min(night) AS first_, max(CASE WHEN night = a + 1 THEN night END) AS second_, arg_max(night, ((date_diff('day', DATE '1970-01-01', start + CAST(night - 1 AS INT)) * 7 + zone) % 11) * 1000 - night) AS darkest, any_value(start) AS start FROM j WHERE free = 0 OR NOT used GROUP BY trip),
k AS (SELECT j.*, CASE WHEN sky THEN CASE WHEN j.start IS NOT NULL THEN m.darkest ELSE coalesce(m.second_, m.first_) END END AS at_stars FROM j JOIN m USING (trip)),
o AS (SELECT trip, night, CASE WHEN night = at_stars THEN 'stars' WHEN night = at_show THEN 'show' WHEN rest THEN 'rest' WHEN goes THEN 'out' END AS kind, id FROM k)
SELECT trip, CAST(night AS INT) AS night, kind, CASE WHEN kind = 'show' THEN id END AS show FROM o WHERE kind IS NOT NULL"""

QUERIES = {"G35_night_plans": (lambda s, d: ni.night_plans(*tables(s, d)), _SQL)}
