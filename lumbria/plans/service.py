"""What the service answers, and the published band sets, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import scoring as sc
from .relational import T
from .travel import seasons, stops, zones

c = F.col


def _events(s: SparkSession, d: str) -> DataFrame:
    o = T(s, d, "orders")
    return o.select(c("o_orderkey").alias("id"), F.concat(F.lit("e"), c("o_orderkey") % 50).alias("name"), (c("o_custkey") % 100 + 1).alias("zone"), c("o_orderdate").cast("date").alias("start_date"), F.date_add(c("o_orderdate").cast("date"), (c("o_orderkey") % 5).cast("int")).alias("end_date"))


def _options(s: SparkSession, d: str) -> DataFrame:
    return api.options(T(s, d, "region").select(c("r_regionkey").alias("origin"), c("r_name").alias("name")), stops(s, d))


def _sheet(s: SparkSession, d: str) -> DataFrame:
    z = api.zone_sheet(7, zones(s, d), stops(s, d).withColumn("name", F.concat(F.lit("n"), c("stop") % 5)), seasons(s, d), _events(s, d), "1996-03-01")
    return z.select("zone", F.array_join("stops", ",").alias("stops"), F.array_join(F.transform("months", lambda m: m["factor"].cast("string")), ",").alias("months"), F.array_join(F.transform("events", lambda e: F.concat(e["start_date"].cast("string"), e["name"])), ",").alias("events"))


_SHEET = """WITH s AS (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY -r, n, k) AS stops FROM (SELECT c_custkey AS k, c_custkey % 4 AS r, 'n' || c_custkey % 5 AS n FROM customer WHERE c_custkey % 100 + 1 = 7)),
m AS (SELECT string_agg(['1.0', '0.75', '0.4'][(7 + i) % 3 + 1], ',' ORDER BY i) AS months FROM (SELECT unnest(range(1, 13)) AS i)),
e AS (SELECT o_custkey % 100 + 1 AS zone, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS b, 'e' || o_orderkey % 50 AS name FROM orders),
f AS (SELECT coalesce(string_agg(strftime(a, '%Y-%m-%d') || name, ',' ORDER BY a, b, name), '') AS events FROM e WHERE zone = 7 AND a <= DATE '1997-02-28' AND b >= DATE '1996-03-01')
SELECT s_suppkey AS zone, coalesce(stops, '') AS stops, months, events FROM supplier, s, m, f WHERE s_suppkey = 7"""


def _published(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).select("id", "name", "start_date", "end_date", F.lit(1.0).alias("lat"), F.when(c("id") % 11 > 0, 2.0).alias("lon"), c("start_date").alias("published"))
    again = e.where("id % 4 = 1").withColumn("name", F.concat(c("name"), F.lit("x"))).withColumn("published", F.date_add("published", 1))
    kept, _ = api.published(e.where("id % 3 = 0"), again, "1998-01-01")
    return kept.select("id", "name")


_PUBLISHED = """WITH e AS (SELECT o_orderkey AS id, 'e' || o_orderkey % 50 AS name, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS b FROM orders),
u AS (SELECT id, name, a, b, a AS p FROM e WHERE id % 3 = 0 UNION ALL SELECT id, name || 'x', a, b, a + 1 FROM e WHERE id % 4 = 1 AND b >= DATE '1998-01-01' AND id % 11 > 0),
l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, name DESC) = 1) SELECT id, name FROM l WHERE b + 2 > DATE '1998-01-01' ORDER BY a, id LIMIT 500"""


def _bands(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "part").select("p_partkey", (c("p_partkey") % 150).cast("double").alias("rain"), (c("p_partkey") % 31).cast("double").alias("warm"), F.when(c("p_partkey") % 13 > 0, (c("p_partkey") * 37 % 5200).cast("double")).alias("alt"), F.when(c("p_partkey") % 3 == 0, "Loreto").otherwise("Cusco").alias("region"), F.when(c("p_partkey") % 4 == 0, "2. MANIFESTACIONES CULTURALES").otherwise("1. SITIOS NATURALES").alias("kind"))
    return p.select("p_partkey", sc.band(c("rain"), *sc.RAIN_BANDS).alias("rain"), sc.band(c("warm"), *sc.WARMTH_BANDS).alias("warm"), sc.climate_zone(c("alt"), c("region")).alias("climate"), sc.cost_index(c("rain"), c("kind")).alias("cost"))


_BANDS = """WITH p AS (SELECT p_partkey, p_partkey % 150 AS r, p_partkey % 31 AS w, CASE WHEN p_partkey % 13 > 0 THEN p_partkey * 37 % 5200 END AS a FROM part)
SELECT p_partkey, CASE WHEN r <= 30 THEN '1_Seguro' WHEN r <= 100 THEN '2_Precaucion' ELSE '3_Peligro' END AS rain, CASE WHEN w <= 10 THEN 'Frio' WHEN w <= 20 THEN 'Templado' ELSE 'Calido' END AS warm,
CASE WHEN a IS NULL THEN NULL WHEN p_partkey % 3 = 0 AND a < 1500 THEN 'Tropical Húmedo (Selva)' WHEN a <= 500 THEN 'Cálido / Desértico (Costa)' WHEN a <= 2300 THEN 'Templado Cálido (Yunga)' WHEN a <= 3500 THEN 'Templado Seco (Quechua)' WHEN a <= 4000 THEN 'Frío (Suni)' WHEN a <= 4800 THEN 'Muy Frío (Puna)' ELSE 'Glacial / Nieve (Janca)' END AS climate,
CAST(least(CASE WHEN r < 15 THEN 1 WHEN r < 60 THEN 2 ELSE 3 END + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END, 3) AS INT) AS cost FROM p"""

QUERIES = {
    "API_options": (_options, "SELECT 'origin' AS kind, CAST(r_regionkey AS VARCHAR) AS id, r_name AS label, CAST(NULL AS BIGINT) AS n FROM region UNION ALL SELECT 'interest', i, i, count(*) FROM (SELECT unnest(['i' || c_custkey % 5, 'i' || c_custkey % 3]) AS i FROM customer) GROUP BY i UNION ALL SELECT * FROM (VALUES ('range', 'days_min', 'days', 1), ('range', 'days_max', 'days', 14), ('range', 'budget_min', 'budget', 50), ('range', 'budget_max', 'budget', 20000), ('range', 'max_altitude_min', 'max_altitude', 500), ('range', 'max_altitude_max', 'max_altitude', 5500))"),
    "API_zone_sheet": (_sheet, _SHEET),
    "API_events": (lambda s, d: api.events_between(_events(s, d), "1996-01-01", "1996-06-30", 9).select("id", "name"), "SELECT o_orderkey AS id, 'e' || o_orderkey % 50 AS name FROM orders WHERE o_custkey % 100 + 1 = 9 AND CAST(o_orderdate AS DATE) <= DATE '1996-06-30' AND CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) >= DATE '1996-01-01'"),
    "API_published": (_published, _PUBLISHED),
    "API_comments": (lambda s, d: api.comments(T(s, d, "events").select(c("event_id").alias("id"), c("ts").alias("at")), 20).select("id", "total"), "SELECT event_id AS id, (SELECT count(*) FROM events) AS total FROM events ORDER BY ts DESC, event_id DESC LIMIT 20"),
    "API_health": (lambda s, d: api.health({n: T(s, d, n) for n in ("region", "nation", "supplier")}), "SELECT 'region' AS name, count(*) AS rows, count(*) > 0 AS ok FROM region UNION ALL SELECT 'nation', count(*), count(*) > 0 FROM nation UNION ALL SELECT 'supplier', count(*), count(*) > 0 FROM supplier"),
    "P16_published_bands": (_bands, _BANDS),
}
