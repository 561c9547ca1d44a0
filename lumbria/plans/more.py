"""Sources, predicates, reports and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, parsers, text as x
from ..operators import usage as u
from ..session import scratch
from ..sources import files
from .places import _LAT, _LON, _SQL, customers
from .relational import T

c = F.col


def _csv(encoding: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        p = T(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(" ñandú")).alias("p_name"), "p_size", "p_retailprice").coalesce(1)
        path = scratch(s, "csv")
        files.write_delimited(p, path, encoding=encoding)
        return files.read_delimited(s, path, p.schema, ["p_partkey"], encoding=encoding)

    return run


def _store(s: SparkSession, d: str) -> DataFrame:
    o = T(s, d, "orders").select("o_custkey", c("o_orderdate").cast("string").alias("at"), "o_orderkey")
    path = scratch(s, "store")
    o.select(F.to_json(F.struct("*")).alias("value")).unionByName(s.range(3).select(F.lit("{broken").alias("value"))).write.text(path)
    return files.read_store(s, path, o.schema, "o_custkey", ["at", "o_orderkey"]).select("o_custkey", "o_orderkey")


def _series(s: SparkSession, d: str) -> DataFrame:
    days = F.transform(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-10").cast("date")), lambda v: v.cast("string"))
    z = T(s, d, "nation").select(c("n_nationkey").alias("zone"), F.when(c("n_nationkey") % 5 == 0, F.slice(days, 1, 9)).otherwise(days).alias("time"), F.transform(F.sequence(F.lit(1), F.lit(10)), lambda v: (v * c("n_nationkey")).cast("double")).alias("rain"))
    return files.daily_series(z, "2024-01-01", "2024-01-10", ["rain"])


def _search(s: SparkSession, d: str) -> DataFrame:
    """Zones by what is typed: the name from its start, from a later word, then a place there, then the region."""
    z = T(s, d, "nation").join(T(s, d, "region"), c("n_regionkey") == c("r_regionkey"))
    best = T(s, d, "supplier").where(x.folded(c("s_name"), False).rlike(r"0+1\d$")).groupBy("s_nationkey").agg(F.max(c("s_suppkey") % 9).alias("rank"))
    z = z.join(F.broadcast(best), c("n_nationkey") == c("s_nationkey"), "left")
    tails = lambda v: F.transform(F.sequence(F.lit(1), F.size(F.split(v, "_"))), lambda i: F.array_join(F.slice(F.split(v, "_"), i, F.lit(99)), ""))
    typed = T(s, d, "region").select(F.element_at(F.array(*map(F.lit, ("nat", "1", "as", "af", "2"))), c("r_regionkey") + 1).alias("typed"))
    hit = lambda v: F.array_position(F.transform(tails(x.folded(v, False)), lambda w: w.startswith(c("typed"))), True)
    tier = F.when(hit(c("n_name")) == 1, 0).when(hit(c("n_name")) > 1, 1).when(c("rank").isNotNull() & (F.length("typed") >= 3), 10 - c("rank")).when(hit(c("r_name")) > 0, 11)
    return typed.crossJoin(F.broadcast(z)).select("typed", "n_nationkey", tier.cast("int").alias("tier")).where("tier IS NOT NULL")


_SEARCH = """WITH b AS (SELECT s_nationkey, max(s_suppkey % 9) AS rank FROM supplier WHERE regexp_matches(lower(s_name), '0+1\\d$') GROUP BY 1),
z AS (SELECT n_nationkey, lower(n_name) AS n, lower(r_name) AS r, rank FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN b ON s_nationkey = n_nationkey), t AS (SELECT ['nat', '1', 'as', 'af', '2'][r_regionkey + 1] AS typed FROM region),
h AS (SELECT typed, n_nationkey, rank, list_position(list_transform(range(1, len(string_split(n, '_')) + 1), lambda i: starts_with(array_to_string(string_split(n, '_')[i:], ''), typed)), true) AS hn, list_position(list_transform(range(1, len(string_split(r, '_')) + 1), lambda i: starts_with(array_to_string(string_split(r, '_')[i:], ''), typed)), true) AS hr FROM t, z),
k AS (SELECT typed, n_nationkey, CAST(CASE WHEN hn = 1 THEN 0 WHEN hn > 1 THEN 1 WHEN rank IS NOT NULL AND length(typed) >= 3 THEN 10 - rank WHEN hr > 0 THEN 11 END AS INT) AS tier FROM h) SELECT * FROM k WHERE tier IS NOT NULL"""


def _business(s: SparkSession, d: str) -> DataFrame:
    """Per channel: visitors, buyers, their rate, revenue, variable and marketing cost; fixed cost isn't prorated."""
    o = T(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    k = T(s, d, "customer").join(o, c("c_custkey") == c("o_custkey"), "left").groupBy(c("c_mktsegment").alias("channel")).agg(F.count(F.lit(1)).alias("users"), F.count_if(c("n") >= 10).alias("buyers"), (F.sum(F.when(c("n") >= 10, 30 + c("c_custkey") % 40).otherwise(0))).alias("revenue"))
    return k.select("channel", "users", "buyers", F.try_divide(c("buyers") * 100.0, c("users")).alias("rate"), "revenue", (c("revenue") - 4 * c("buyers") - 2 * c("users") - 1000).alias("profit"))


_BUS = "WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT c_mktsegment AS channel, count(*) AS users, count(*) FILTER (n >= 10) AS buyers, CAST(sum(CASE WHEN n >= 10 THEN 30 + c_custkey % 40 ELSE 0 END) AS BIGINT) AS revenue FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1) SELECT channel, users, buyers, 100.0 * buyers / users AS rate, revenue, revenue - 4 * buyers - 2 * users - 1000 AS profit FROM k"


def _coverage(s: SparkSession, d: str) -> DataFrame:
    """Per segment: distinct zones, share of the five most frequent, and the median."""
    n = T(s, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("c_mktsegment").orderBy(c("n").desc(), "c_nationkey")
    return n.withColumn("r", F.row_number().over(w)).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("zones"), (F.sum(F.when(c("r") <= 5, c("n"))) * 100.0 / F.sum("n")).alias("top5"), F.percentile("n", F.lit(0.5)).alias("p50"))


def _overlap(s: SparkSession, d: str) -> DataFrame:
    z = T(s, d, "customer").where("c_acctbal > 9000").groupBy("c_mktsegment").agg(F.collect_set("c_nationkey").alias("z"))
    return z.alias("a").join(z.alias("b"), c("a.c_mktsegment") < c("b.c_mktsegment")).select(c("a.c_mktsegment").alias("a"), c("b.c_mktsegment").alias("b"), F.size(F.array_intersect("a.z", "b.z")).alias("both"), F.size(F.array_union("a.z", "b.z")).alias("any"))


def _compatible(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "part")
    p = p.crossJoin(F.broadcast(p.agg(F.max("p_retailprice").alias("top"))))  # one row
    p = p.withColumn("score", 0.45 * (c("p_size") / 50) + 0.35 * (c("p_partkey") % 10 / 10) + 0.2 * (c("p_retailprice") / c("top")))
    return p.orderBy(F.round("score", 9).desc(), (c("p_partkey") % 7).desc(), "p_partkey").limit(25).select("p_partkey", F.round("score", 9).alias("score"))


def _fame(s: SparkSession, d: str) -> DataFrame:
    f = T(s, d, "lineitem").join(T(s, d, "supplier"), c("l_suppkey") == c("s_suppkey")).groupBy("l_returnflag", "s_nationkey").agg(F.sum(c("l_quantity").cast("long")).alias("fame"))
    return f.withColumn("r", F.row_number().over(Window.partitionBy("l_returnflag").orderBy(c("fame").desc(), "s_nationkey"))).where("r <= 3")


def _pace(s: SparkSession, d: str) -> DataFrame:
    """Grid search of two parameters with the least mean absolute error, one group left out at a time; equal rows are
    counted before they meet the grid."""
    l = T(s, d, "lineitem").groupBy((c("l_orderkey") % 4).alias("g"), (c("l_partkey") % 100).cast("double").alias("km"), c("l_quantity").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    grid = s.range(1, 9).select((c("id") / 8).alias("a")).crossJoin(s.range(0, 5).select((c("id") * 5).cast("double").alias("b")))
    e = l.crossJoin(F.broadcast(grid)).groupBy("g", "a", "b").agg(F.sum(F.abs(c("a") * c("km") + c("b") - c("m")) * c("n")).alias("e"))
    out = e.select("a", "b", c("g").alias("h"), "e").join(s.range(4).select(c("id").alias("g")), c("h") != c("g")).groupBy("g", "a", "b").agg(F.round(F.sum("e"), 6).alias("e"))
    return out.groupBy("g").agg(F.min(F.struct("e", "a", "b")).alias("x")).select("g", "x.a", "x.b", "x.e")


def _traffic(s: SparkSession, d: str) -> DataFrame:
    h = T(s, d, "events").groupBy((c("user_id") % 5).alias("town"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return h.select("town", "hour", (c("n") / F.max("n").over(Window.partitionBy("town"))).alias("factor"))


QUERIES = {
    "S1_csv_windows1252": (_csv("windows-1252"), "SELECT p_partkey, p_name || ' ñandú' AS p_name, p_size, p_retailprice FROM part"),
    "S2_csv_utf8": (_csv("utf-8"), "SELECT p_partkey, p_name || ' ñandú' AS p_name, p_size, p_retailprice FROM part"),
    "S7_complete_series": (_series, "SELECT n_nationkey AS zone, CAST(DATE '2024-01-01' + CAST(i - 1 AS INT) AS DATE) AS day, CAST(i * n_nationkey AS DOUBLE) AS rain FROM nation, (SELECT unnest(range(1, 11)) AS i) WHERE n_nationkey % 5 <> 0"),
    "S12_json_lines_store": (_store, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"),
    "S15_manifest": (lambda s, d: files.manifest({n: T(s, d, n) for n in ("region", "nation", "part")}), None),
    "P3_waterfall": (lambda s, d: T(s, d, "part").select("p_partkey", F.when(c("p_type") == "PROMO", "promo").when(c("p_size").isNull(), "no_size").when(c("p_partkey") % 11 == 0, "check").when((c("p_size") > 45) & (c("p_retailprice") > 1000), "peak").alias("why")), "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'promo' WHEN p_size IS NULL THEN 'no_size' WHEN p_partkey % 11 = 0 THEN 'check' WHEN p_size > 45 AND p_retailprice > 1000 THEN 'peak' END AS why FROM part"),
    "P4_ticket_kinds": (lambda s, d: T(s, d, "part").select("p_partkey", F.when(c("p_name").rlike("(?i)libre|ring"), "free").when(c("p_retailprice") > 1000, "paid").otherwise("unknown").alias("kind")), "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)libre|ring') THEN 'free' WHEN p_retailprice > 1000 THEN 'paid' ELSE 'unknown' END AS kind FROM part"),
    "P5_numeric_cleaning": (lambda s, d: T(s, d, "part").select("p_partkey", F.nullif(F.nanvl(F.when(c("p_partkey") % 5 == 0, F.lit(float("nan"))).otherwise(c("p_size").cast("double")), F.lit(-1.0)), F.lit(-1.0)).alias("v")), "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS v FROM part"),
    "P7_all_sources": (lambda s, d: T(s, d, "part").where(F.expr("size(split(p_name, ' ')) > 0 AND forall(split(p_name, ' '), w -> length(w) > 3)")).select("p_partkey"), "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: length(w) <= 3)) = 0"),
    "P9_coordinate_checks": (lambda s, d: customers(s, d).select("id", ((geo.haversine_km(c("lat"), c("lon"), F.lit(-10.0), F.lit(-75.0)) > 400) & ~(F.abs(c("alt") - 2000) < 300)).alias("check")), f"{_SQL} SELECT id, 2 * 6371 * asin(sqrt(pow(sin(radians(-10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(-10)) * pow(sin(radians(-75 - lon) / 2), 2))) > 400 AND NOT abs(alt - 2000) < 300 AS \"check\" FROM c"),
    "P10_altitude_source": (lambda s, d: customers(s, d).select("id", F.when(F.abs(c("alt") - (c("id") % 4000)) > 500, c("id") % 4000).otherwise(F.coalesce(F.when(c("id") % 3 > 0, c("alt")), c("id") % 4000)).cast("double").alias("m")), f"{_SQL} SELECT id, CAST(CASE WHEN abs(alt - id % 4000) > 500 THEN id % 4000 ELSE coalesce(CASE WHEN id % 3 > 0 THEN alt END, id % 4000) END AS DOUBLE) AS m FROM c"),
    "P12_plausible": (lambda s, d: T(s, d, "lineitem").where(c("l_quantity").between(5, 45) & (c("l_extendedprice") / c("l_quantity")).between(900, 2500)).select("l_orderkey", "l_linenumber", "l_partkey"), "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND l_extendedprice / l_quantity BETWEEN 900 AND 2500"),
    "A26_grid_audit": (_coverage, "WITH n AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_nationkey) AS r FROM n) SELECT c_mktsegment, count(*) AS zones, sum(CASE WHEN r <= 5 THEN n END) * 100.0 / sum(n) AS top5, quantile_cont(n, 0.5) AS p50 FROM r GROUP BY 1"),
    "A30_overlap": (_overlap, "WITH z AS (SELECT c_mktsegment AS m, list_distinct(list(c_nationkey)) AS z FROM customer WHERE c_acctbal > 9000 GROUP BY 1) SELECT a.m AS a, b.m AS b, CAST(len(list_intersect(a.z, b.z)) AS INT) AS \"both\", CAST(len(list_distinct(list_concat(a.z, b.z))) AS INT) AS \"any\" FROM z a JOIN z b ON a.m < b.m"),
    "A31_business_funnel": (_business, _BUS),
    "A34_range_audit": (lambda s, d: T(s, d, "lineitem").groupBy(F.when(c("l_quantity") < 10, "below").when(c("l_quantity") > 40, "above").otherwise("inside").alias("place")).agg(F.count(F.lit(1)).alias("n"), F.percentile(c("l_quantity") / 25, F.lit(0.5)).alias("ratio")), "SELECT CASE WHEN l_quantity < 10 THEN 'below' WHEN l_quantity > 40 THEN 'above' ELSE 'inside' END AS place, count(*) AS n, quantile_cont(l_quantity / 25, 0.5) AS ratio FROM lineitem GROUP BY 1"),
    "A37_route_indicators": (lambda s, d: T(s, d, "lineitem").join(T(s, d, "part").select("p_partkey", "p_size"), c("l_partkey") == c("p_partkey")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("stops"), F.avg("p_size").alias("mean"), F.count_if(c("p_size") >= 40).alias("high"), F.max("p_size").alias("top")), "SELECT l_orderkey, count(*) AS stops, avg(p_size) AS mean, count(*) FILTER (p_size >= 40) AS high, max(p_size) AS top FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "A38_cost_lines": (lambda s, d: T(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(c("l_returnflag") != "R", c("l_quantity").cast("long")).otherwise(0)).alias("single"), F.coalesce(F.max(F.when(c("l_returnflag") == "R", c("l_quantity").cast("long"))), F.lit(0)).alias("combined")).withColumn("total", c("single") + c("combined")), "SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS single, CAST(coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS BIGINT) AS combined, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) + coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS BIGINT) AS total FROM lineitem GROUP BY 1"),
    "F5_altitude": (lambda s, d: T(s, d, "nation").select("n_nationkey", parsers.altitude(F.expr("element_at(array('350', '3,399 m', '3.635 msnm', '2 650 msnm', '150 - 1550', '4310 a 4546', '8548773', 'sin dato', '4, 138', '1 y 2 y 3'), n_nationkey % 10 + 1)")).alias("a")).select("n_nationkey", "a.low", "a.high"), "SELECT n_nationkey, CAST([350, 3399, 3635, 2650, 150, 4310, NULL, NULL, 4138, NULL][n_nationkey % 10 + 1] AS DOUBLE) AS low, CAST([350, 3399, 3635, 2650, 1550, 4546, NULL, NULL, 4138, NULL][n_nationkey % 10 + 1] AS DOUBLE) AS high FROM nation"),
    "F8_open_days": (lambda s, d: T(s, d, "nation").select("n_nationkey", F.array_join(parsers.open_days(F.expr("element_at(array('De martes a domingo', 'Sábados y domingos', 'todos los días excepto lunes', 'lunes cerrado', 'viernes a lunes', 'con reserva'), n_nationkey % 6 + 1)")), ",").alias("days")), "SELECT n_nationkey, ['1,2,3,4,5,6', '5,6', '1,2,3,4,5,6', '1,2,3,4,5,6', '0,4,5,6', NULL][n_nationkey % 6 + 1] AS days FROM nation"),
    "F35_zone_search": (_search, _SEARCH),
    "F36_rounding": (lambda s, d: T(s, d, "part").select("p_partkey", F.bround(c("p_size") / 2).alias("even"), F.round(c("p_size") / 2).alias("up")), "SELECT p_partkey, round_even(p_size / 2, 0) AS even, round(p_size / 2) AS up FROM part"),
    "G23_pace_grid": (_pace, "WITH l AS (SELECT l_orderkey % 4 AS g, CAST(l_partkey % 100 AS DOUBLE) AS km, l_quantity AS m FROM lineitem), p AS (SELECT i / 8 AS a, CAST(k * 5 AS DOUBLE) AS b FROM (SELECT unnest(range(1, 9)) AS i), (SELECT unnest(range(0, 5)) AS k)), e AS (SELECT g, a, b, sum(abs(a * km + b - m)) AS e FROM l, p GROUP BY ALL), o AS (SELECT x.g, a, b, round(sum(e), 6) AS e FROM e JOIN (SELECT unnest(range(4)) AS g) x ON e.g <> x.g GROUP BY ALL) SELECT g, a, b, e FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY e, a, b) AS r FROM o) WHERE r = 1"),
    "G34_two_sources": (lambda s, d: u.correlations(T(s, d, "part").select(c("p_size").cast("double").alias("a"), F.when(c("p_partkey") % 4 > 0, c("p_retailprice")).alias("b")), ["a", "b"], 6).where("x < y").withColumn("r", F.round("r", 6)), "SELECT 'a' AS x, 'b' AS y, count(*) AS n, round(corr(p_size, p_retailprice), 6) AS r FROM part WHERE p_partkey % 4 > 0"),
    "G37_compatibility": (_compatible, "SELECT p_partkey, round(s, 9) AS score FROM (SELECT *, 0.45 * (p_size / 50) + 0.35 * (p_partkey % 10 / 10) + 0.2 * (p_retailprice / max(p_retailprice) OVER ()) AS s FROM part) ORDER BY round(s, 9) DESC, p_partkey % 7 DESC, p_partkey LIMIT 25"),
    "G43_traffic": (_traffic, "WITH h AS (SELECT user_id % 5 AS town, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY ALL) SELECT town, hour, n / max(n) OVER (PARTITION BY town) AS factor FROM h"),
    "G44_baseline": (_fame, "WITH f AS (SELECT l_returnflag, s_nationkey, CAST(sum(l_quantity) AS BIGINT) AS fame FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT l_returnflag, s_nationkey, fame, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY fame DESC, s_nationkey) AS r FROM f) WHERE r <= 3"),
    "Q3_monthly_counts": (lambda s, d: T(s, d, "events").groupBy(F.hour("ts").alias("hour"), (c("user_id") % 10).alias("row"), (c("user_id") % 7).alias("col")).agg(F.count_if(c("value") > 5).alias("valid"), F.count_if(c("value") > 50).alias("clear")), "SELECT CAST(hour(ts) AS INT) AS hour, user_id % 10 AS row, user_id % 7 AS col, count(*) FILTER (value > 5) AS valid, count(*) FILTER (value > 50) AS clear FROM events GROUP BY 1, 2, 3"),
    "Q4_marker_substring": (lambda s, d: T(s, d, "part").select("p_partkey", F.expr("substring(p_name, least(nullif(instr(p_name, 'ri'), 0), nullif(instr(p_name, 'a'), 0)), 5)").alias("t")), "SELECT p_partkey, substring(p_name, CASE WHEN instr(p_name, 'ri') = 0 THEN nullif(instr(p_name, 'a'), 0) WHEN instr(p_name, 'a') = 0 THEN instr(p_name, 'ri') ELSE least(instr(p_name, 'ri'), instr(p_name, 'a')) END, 5) AS t FROM part"),
    "Q5_tiles": (lambda s, d: customers(s, d).select("id", F.format_string("S%02dW%03d", (-F.floor("lat")).cast("int"), (-F.floor("lon")).cast("int")).alias("tile")), f"{_SQL} SELECT id, format('S{{:02d}}W{{:03d}}', CAST(-floor(lat) AS INT), CAST(-floor(lon) AS INT)) AS tile FROM c"),
    "Q8_name_cut": (lambda s, d: T(s, d, "customer").select("c_custkey", F.regexp_extract("c_name", "^([^#]*)", 1).alias("name")), "SELECT c_custkey, split_part(c_name, '#', 1) AS name FROM customer"),
    "Q9_polygon_centre": (lambda s, d: T(s, d, "lineitem").select(c("l_orderkey").alias("way"), c("l_suppkey").alias("node")).distinct().select("way", F.expr(_LAT.format(k="node")).alias("lat"), F.expr(_LON.format(k="node")).alias("lon")).groupBy("way").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon")), "SELECT way, round(avg(" + _LAT.format(k="node").replace("0D", "0::DOUBLE") + "), 6) AS lat, round(avg(" + _LON.format(k="node").replace("0D", "0::DOUBLE") + "), 6) AS lon FROM (SELECT DISTINCT l_orderkey AS way, l_suppkey AS node FROM lineitem) GROUP BY way"),
    "Q10_calendar_month": (lambda s, d: T(s, d, "orders").where("o_orderdate < TIMESTAMP_NTZ '1997-07-01' AND date_add(o_orderdate, CAST(o_orderkey % 40 AS INT)) >= DATE '1997-06-01'").select("o_orderkey", F.when(c("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1997-06-01'"), "starts").otherwise("goes on").alias("kind")), "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1997-06-01' THEN 'starts' ELSE 'goes on' END AS kind FROM orders WHERE o_orderdate < TIMESTAMP '1997-07-01' AND CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) >= DATE '1997-06-01'"),
}
