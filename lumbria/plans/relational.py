"""Relational operators on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins as j
from ..operators import tables as t


def T(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


c, w = F.col, Window.partitionBy


def _n():
    return F.count(F.lit(1)).alias("n")


def _rev():
    return (c("l_extendedprice") * (1 - c("l_discount"))).cast("decimal(18,4)")


_REV = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"


def _orders_day(s, d):
    return T(s, d, "orders").select("o_orderkey", "o_custkey", c("o_orderdate").cast("date").alias("a"), F.date_add(c("o_orderdate").cast("date"), (c("o_orderkey") % 9).cast("int")).alias("b"))


def _windows(s, d):
    return T(s, d, "nation").select("n_nationkey", F.expr("make_date(1995 + n_nationkey % 5, 1 + n_nationkey % 12, 10)").alias("wa"), F.expr("date_add(make_date(1995 + n_nationkey % 5, 1 + n_nationkey % 12, 10), 20)").alias("wb"))


_OW = "o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) AS b FROM orders), v AS (SELECT n_nationkey, make_date(1995 + n_nationkey % 5, 1 + n_nationkey % 12, 10) AS wa, make_date(1995 + n_nationkey % 5, 1 + n_nationkey % 12, 10) + 20 AS wb FROM nation)"


def _old_new(s, d):
    o = T(s, d, "part")
    old = o.where("p_partkey % 11 <> 0").select("p_partkey", "p_brand", "p_size", c("p_retailprice").alias("price"))
    new = o.where("p_partkey % 13 <> 0").select("p_partkey", "p_brand", F.expr("IF(p_partkey % 7 = 0, p_size + 1, p_size)").alias("p_size"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_retailprice * 1.2D ELSE p_retailprice END").alias("price"))
    return old, new


_ON = "o AS (SELECT p_partkey, p_brand, p_size, p_retailprice AS price FROM part WHERE p_partkey % 11 <> 0), m AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_retailprice * 1.2::DOUBLE ELSE p_retailprice END AS price FROM part WHERE p_partkey % 13 <> 0)"


def _asof(s, d):
    e = T(s, d, "events")
    days = e.select("user_id", F.to_date("ts").alias("day")).distinct()
    target = days.select("user_id", "day", F.explode(F.array(F.lit(2), F.lit(6))).alias("h")).select("user_id", "day", "h", F.expr("CAST(day AS TIMESTAMP_NTZ) + make_interval(0, 0, 0, 0, h)").alias("at"))
    return j.asof_nearest(target, e.select("user_id", "event_id", "ts"), ["user_id"], "at", "ts", 1800, ["ts", "event_id"], ["user_id", "day", "h"]).select("user_id", "day", "h", "event_id", c("gap_s").cast("int").alias("gap_s"))


def _rules(s, d):
    """A part's value by brand and type over type over size band, with a floor; the first rule found counts."""
    p = T(s, d, "part")
    by = lambda v, name, *k: p.groupBy(*k).agg(F.min("p_partkey").alias("m")).where(f"m % 3 = {v}").select(*k, c("m").alias(name))
    out = p
    for v, name, k in ((0, "r1", ("p_brand", "p_type", "p_size")), (1, "r2", ("p_brand", "p_type")), (2, "r3", ("p_type",)), (0, "r4", ("p_size",))):
        out = out.join(by(v, name, *k), list(k), "left")
    return out.select("p_partkey", F.greatest(F.coalesce("r1", "r2", "r3", "r4", F.lit(-1)), F.when(c("p_size") > 40, F.lit(25)).otherwise(F.lit(0))).alias("value"))


def _labels_by_rule(s, d):
    """Interests by rules with exclusions: union of what words give, less what they forbid."""
    give = F.array_distinct(F.flatten(F.transform(F.split("p_name", " "), lambda x: F.when(x.like("s%"), F.array(F.lit("s"), F.lit("any"))).when(x.like("%ing"), F.array(F.lit("ring"), F.lit("any"))).otherwise(F.array(F.lit("any"))))))
    bar = F.when(c("p_name").like("%small%"), F.array(F.lit("any"))).otherwise(F.array().cast("array<string>"))
    return T(s, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_except(give, bar)), "|").alias("labels"))


def _best_source(s, d):
    """Each order's first line by a preference list of ship modes held as text, exploded with its place."""
    l = T(s, d, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice")
    pref = s.range(1).select(F.posexplode(F.split(F.lit("R|A|N"), r"\|")).alias("pos", "l_returnflag"))
    return l.join(F.broadcast(pref), "l_returnflag").groupBy("l_orderkey").agg(F.min(F.struct("pos", (-c("l_extendedprice")).alias("m"), "l_returnflag")).alias("b")).select("l_orderkey", c("b.l_returnflag").alias("flag"), (-c("b.m")).alias("price"))


QUERIES = {
    "P1_rename_prune_sort": (lambda s, d: T(s, d, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name")).orderBy("name", "id"), "SELECT s_suppkey AS id, s_name AS name FROM supplier"),
    "P2_case": (lambda s, d: T(s, d, "part").select("p_partkey", F.when(c("p_size") > 40, "large").when(c("p_retailprice") > 1200, "dear").when(c("p_type") == "ECONOMY", "plain").otherwise("other").alias("kind")), "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_retailprice > 1200 THEN 'dear' WHEN p_type = 'ECONOMY' THEN 'plain' ELSE 'other' END AS kind FROM part"),
    "J1_left_join": (lambda s, d: T(s, d, "customer").join(T(s, d, "orders").where("o_totalprice > 300000").select("o_custkey", "o_orderkey"), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey"), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey"),
    "J2_composite_join": (lambda s, d: T(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").alias("a").join(T(s, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey", c("l_quantity").alias("q")).alias("b"), ["l_orderkey", "l_suppkey"]).select("l_orderkey", "l_suppkey", "l_partkey", "q"), "SELECT a.l_orderkey, a.l_suppkey, a.l_partkey, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey WHERE b.l_linenumber = 1"),
    "J3_full_outer_changes": (lambda s, d: t.classify_changes(*_old_new(s, d), ["p_partkey"], "price", 0.1), f"WITH {_ON} SELECT p_partkey, CASE WHEN NOT oo THEN 'new' WHEN NOT nn THEN 'gone' WHEN a IS NULL AND b IS NOT NULL THEN 'gained' WHEN a IS NOT NULL AND b IS NULL THEN 'lost' WHEN b > a * 1.1::DOUBLE THEN 'worse' WHEN b < a * 0.9::DOUBLE THEN 'better' ELSE 'same' END AS change FROM (SELECT coalesce(o.p_partkey, m.p_partkey) AS p_partkey, o.price AS a, m.price AS b, o.p_partkey IS NOT NULL AS oo, m.p_partkey IS NOT NULL AS nn FROM o FULL JOIN m ON o.p_partkey = m.p_partkey)"),
    "J4_lookup_default": (lambda s, d: T(s, d, "customer").join(F.broadcast(T(s, d, "nation").where("n_nationkey < 20")), c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("elsewhere")).alias("place")), "SELECT c_custkey, coalesce(n_name, 'elsewhere') AS place FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey"),
    "J5_semi_join": (lambda s, d: T(s, d, "customer").join(T(s, d, "orders").where("o_orderstatus = 'P'"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "J6_anti_join": (lambda s, d: T(s, d, "customer").join(T(s, d, "orders"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "J11_overlap_join": (lambda s, d: j.overlap_join(_orders_day(s, d), _windows(s, d), "a", "b", "wa", "wb").select("o_orderkey", "n_nationkey"), f"WITH {_OW} SELECT o_orderkey, n_nationkey FROM o JOIN v ON a <= wb AND b >= wa"),
    "J12_asof_join": (_asof, "WITH t AS (SELECT user_id, day, CAST(h AS INT) AS h, CAST(day AS TIMESTAMP) + to_hours(CAST(h AS INT)) AS tat FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), (SELECT unnest([2, 6]) AS h) hh), p AS (SELECT t.*, event_id, abs(epoch_us(ts) - epoch_us(tat)) AS g, row_number() OVER (PARTITION BY t.user_id, day, h ORDER BY abs(epoch_us(ts) - epoch_us(tat)), ts, event_id) AS r FROM t JOIN events e ON t.user_id = e.user_id AND abs(epoch_us(ts) - epoch_us(tat)) <= 1800000000) SELECT user_id, day, h, event_id, CAST(floor(g / 1000000) AS INT) AS gap_s FROM p WHERE r = 1"),
    "J14_grid": (lambda s, d: T(s, d, "region").crossJoin(s.range(1, 13).select(c("id").cast("int").alias("month"))).crossJoin(s.range(2, 6).select(c("id").cast("int").alias("days"))).select("r_regionkey", "month", "days"), "SELECT r_regionkey, CAST(m AS INT) AS month, CAST(n AS INT) AS days FROM region, (SELECT unnest(range(1, 13)) AS m), (SELECT unnest(range(2, 6)) AS n)"),
    "J15_remap": (lambda s, d: T(s, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).join(F.broadcast(T(s, d, "nation").select(F.split(F.lit("small|ring|gear|bolt"), r"\|")[c("n_nationkey") % 4].alias("word"), "n_nationkey").where("n_nationkey < 4")), "word").select("p_partkey", "word", "n_nationkey"), "WITH m AS (SELECT ['small', 'ring', 'gear', 'bolt'][n_nationkey + 1] AS word, n_nationkey FROM nation WHERE n_nationkey < 4) SELECT p_partkey, word, n_nationkey FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) JOIN m USING (word)"),
    "J16_first_available": (_best_source, "WITH p AS (SELECT l_orderkey, l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_extendedprice DESC) AS r FROM lineitem WHERE l_returnflag IN ('R', 'A', 'N')) SELECT l_orderkey, l_returnflag AS flag, l_extendedprice AS price FROM p WHERE r = 1"),
    "J21_rule_precedence": (_rules, "WITH r1 AS (SELECT p_brand, p_type, p_size, min(p_partkey) AS m FROM part GROUP BY ALL HAVING m % 3 = 0), r2 AS (SELECT p_brand, p_type, min(p_partkey) AS m FROM part GROUP BY ALL HAVING m % 3 = 1), r3 AS (SELECT p_type, min(p_partkey) AS m FROM part GROUP BY ALL HAVING m % 3 = 2), r4 AS (SELECT p_size, min(p_partkey) AS m FROM part GROUP BY ALL HAVING m % 3 = 0) SELECT p_partkey, greatest(coalesce(r1.m, r2.m, r3.m, r4.m, -1), CASE WHEN p.p_size > 40 THEN 25 ELSE 0 END) AS value FROM part p LEFT JOIN r1 USING (p_brand, p_type, p_size) LEFT JOIN r2 USING (p_brand, p_type) LEFT JOIN r3 USING (p_type) LEFT JOIN r4 USING (p_size)"),
    "J22_label_rules": (_labels_by_rule, "WITH x AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS w FROM part), g AS (SELECT DISTINCT p_partkey, p_name, unnest(CASE WHEN w LIKE 's%' THEN ['s', 'any'] WHEN w LIKE '%ing' THEN ['ring', 'any'] ELSE ['any'] END) AS l FROM x) SELECT p_partkey, coalesce(string_agg(l, '|' ORDER BY l) FILTER (NOT (p_name LIKE '%small%' AND l = 'any')), '') AS labels FROM g GROUP BY p_partkey"),
    "A14_two_level_mean": (lambda s, d: T(s, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("month")).agg(_n()).groupBy("month").agg(F.avg("n").alias("mean")), "SELECT month, avg(n) AS mean FROM (SELECT year(o_orderdate) AS y, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY month"),
    "A15_weighted_mean": (lambda s, d: T(s, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(_n(), F.sum(c("l_quantity").cast("long")).alias("q")).withColumn("share", c("n") / F.sum("n").over(w("l_returnflag"))).groupBy("l_returnflag").agg(F.round(F.sum(c("share") * c("q") / c("n")), 6).alias("mean")), "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1"),
    "A16_mode": (lambda s, d: t.mode_of(T(s, d, "customer"), ["c_nationkey"], "c_mktsegment"), "WITH k AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM k) WHERE r = 1"),
    "A17_share_in_set": (lambda s, d: T(s, d, "orders").groupBy("o_custkey").agg(F.avg(c("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")).alias("share"), (~F.bool_or(c("o_orderstatus") != "F")).alias("all_f")), "SELECT o_custkey, avg(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS share, NOT bool_or(o_orderstatus <> 'F') AS all_f FROM orders GROUP BY 1"),
    "A18_group_profile": (lambda s, d: T(s, d, "customer").groupBy("c_nationkey").agg(_n(), F.countDistinct("c_mktsegment").alias("segments"), F.round(F.max("c_acctbal") - F.min("c_acctbal"), 4).alias("spread"), F.round(F.avg("c_acctbal"), 4).alias("mean")), "SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS segments, round(max(c_acctbal) - min(c_acctbal), 4) AS spread, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1"),
    "A19_quality_profile": (lambda s, d: t.profile(T(s, d, "part").withColumn("p_name", F.expr("IF(p_partkey % 9 = 0, concat(' ', p_name), p_name)")).withColumn("p_size", F.expr("IF(p_partkey % 4 = 0, NULL, p_size)")).select("p_name", "p_size", "p_brand"), {"p_size": (5, 30)}), "WITH p AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN ' ' || p_name ELSE p_name END AS p_name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS p_size, p_brand FROM part) SELECT 'p_name' AS \"column\", count(*) AS n, count(*) - count(p_name) AS nulls, 100.0 * (count(*) - count(p_name)) / count(*) AS null_percent, count(DISTINCT p_name) AS \"distinct\", count(*) FILTER (p_name <> trim(p_name)) AS blank, NULL::DOUBLE AS in_range FROM p UNION ALL SELECT 'p_size', count(*), count(*) - count(p_size), 100.0 * (count(*) - count(p_size)) / count(*), count(DISTINCT p_size), 0, avg(CASE WHEN p_size BETWEEN 5 AND 30 THEN 1.0 WHEN p_size IS NOT NULL THEN 0.0 END) FROM p UNION ALL SELECT 'p_brand', count(*), count(*) - count(p_brand), 100.0 * (count(*) - count(p_brand)) / count(*), count(DISTINCT p_brand), count(*) FILTER (p_brand <> trim(p_brand)), NULL FROM p"),
    "A20_missing_by_group": (lambda s, d: t.missing_by(T(s, d, "part").withColumns({"a": F.expr("IF(p_partkey % 4 = 0, NULL, p_size)"), "b": F.expr("IF(p_partkey % 6 = 0, NULL, p_name)")}), "p_brand", ["a", "b"]), "WITH p AS (SELECT p_brand, count(*) AS total, count(*) FILTER (p_partkey % 4 = 0) AS a, count(*) FILTER (p_partkey % 6 = 0) AS b FROM part GROUP BY 1) SELECT p_brand, total, 'a' AS \"column\", a AS missing, 100.0 * a / total AS percent FROM p UNION ALL SELECT p_brand, total, 'b', b, 100.0 * b / total FROM p"),
    "A21_pivot": (lambda s, d: T(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0), "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1"),
    "A22_value_counts": (lambda s, d: t.value_counts(T(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]), "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2"),
    "A24_difference_summary": (lambda s, d: T(s, d, "lineitem").withColumn("x", F.abs(c("l_quantity") - 25)).groupBy("l_returnflag").agg(_n(), F.percentile("x", F.lit(0.5)).alias("p50"), F.percentile("x", F.lit(0.9)).alias("p90"), F.max("x").alias("most"), F.count_if(c("x") > 20).alias("over20")), "SELECT l_returnflag, count(*) AS n, quantile_cont(abs(l_quantity - 25), 0.5) AS p50, quantile_cont(abs(l_quantity - 25), 0.9) AS p90, max(abs(l_quantity - 25)) AS most, count(*) FILTER (abs(l_quantity - 25) > 20) AS over20 FROM lineitem GROUP BY 1"),
    "A25_error_bands": (lambda s, d: T(s, d, "lineitem").select(F.when(c("l_extendedprice") < 20000, "a").when(c("l_extendedprice") < 60000, "b").otherwise("c").alias("band"), (F.abs(c("l_quantity") - 25) / 25).alias("e"), (c("l_quantity") - 25).alias("bias")).groupBy("band").agg(_n(), F.round(F.avg("e"), 6).alias("mape"), F.percentile("e", F.lit(0.5)).alias("p50"), F.avg((c("e") <= 0.25).cast("int")).alias("within"), F.round(F.avg("bias"), 6).alias("bias")), "SELECT CASE WHEN l_extendedprice < 20000 THEN 'a' WHEN l_extendedprice < 60000 THEN 'b' ELSE 'c' END AS band, count(*) AS n, round(avg(abs(l_quantity - 25) / 25), 6) AS mape, quantile_cont(abs(l_quantity - 25) / 25, 0.5) AS p50, avg(CASE WHEN abs(l_quantity - 25) / 25 <= 0.25 THEN 1 ELSE 0 END) AS within, round(avg(l_quantity - 25), 6) AS bias FROM lineitem GROUP BY 1"),
    "A29_partition_agreement": (lambda s, d: t.partition_agreement(T(s, d, "customer"), "c_nationkey", "c_mktsegment").withColumn("ari", F.round("ari", 9)), "WITH k AS (SELECT c_nationkey AS a, c_mktsegment AS b, count(*)::DOUBLE AS n FROM customer GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2) AS p, sum(n) AS m FROM k), x AS (SELECT sum(n * (n - 1) / 2) AS pa FROM (SELECT sum(n) AS n FROM k GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS pb FROM (SELECT sum(n) AS n FROM k GROUP BY b)) SELECT p AS \"both\", pa - p AS only_a, pb - p AS only_b, round((p - pa * pb / (m * (m - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (m * (m - 1) / 2)), 9) AS ari FROM t, x, y"),
    "W1_rank": (lambda s, d: T(s, d, "part").select("p_partkey", F.rank().over(w("p_brand").orderBy(c("p_size").desc())).alias("place")), "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INT) AS place FROM part"),
    "W3_group_total": (lambda s, d: T(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum(c("l_quantity").cast("long")).over(w("l_orderkey")).alias("total")), "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS BIGINT) AS total FROM lineitem"),
    "W4_differences": (lambda s, d: T(s, d, "events").select("event_id", (F.unix_micros(c("ts").cast("timestamp")) - F.lag(F.unix_micros(c("ts").cast("timestamp"))).over(w("user_id").orderBy("ts", "event_id"))).alias("step")), "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events"),
    "W5_first_per_group": (lambda s, d: T(s, d, "part").groupBy("p_brand").agg(F.max_by("p_name", F.struct("p_size", -c("p_partkey"))).alias("name")), "SELECT p_brand, p_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r = 1"),
    "W6_latest_per_key": (lambda s, d: t.latest(T(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], c("o_orderdate").desc(), c("o_orderkey").desc()), "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"),
    "W7_min_max": (lambda s, d: t.min_max_scaled(T(s, d, "part"), "p_retailprice", "x").select("p_partkey", F.round("x", 9).alias("x")), "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 9) AS x FROM part"),
    "W10_repeat_decay": (lambda s, d: T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.pow(F.lit(0.8), F.row_number().over(w("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey")) - 1), 9).alias("k")), "SELECT l_orderkey, l_linenumber, l_partkey, round(pow(0.8, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) - 1), 9) AS k FROM lineitem"),
    "W12_bucket_change": (lambda s, d: T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.sum(c("l_quantity").cast("long")).over(w("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)).alias("run")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "run", (F.floor(c("run") / 50) > F.coalesce(F.floor(F.lag("run").over(w("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) / 50), F.lit(0))).alias("crosses")), "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM lineitem) SELECT *, run // 50 > coalesce(lag(run) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) // 50, 0) AS crosses FROM x"),
    "T1_top_k": (lambda s, d: T(s, d, "orders").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "T4_top_distinct": (lambda s, d: t.best_distinct(T(s, d, "customer"), "c_nationkey", [c("c_acctbal").desc(), c("c_custkey")], 3).select("c_custkey", "c_nationkey"), "WITH b AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) SELECT c_custkey, c_nationkey FROM b WHERE r = 1 ORDER BY c_acctbal DESC, c_custkey LIMIT 3"),
    "T5_top_per_group": (lambda s, d: T(s, d, "part").withColumn("r", F.row_number().over(w("p_brand").orderBy((c("p_retailprice") / c("p_size")).desc(), "p_partkey"))).where("r <= 40").select("p_brand", "p_partkey", "r"), "SELECT p_brand, p_partkey, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice / p_size DESC, p_partkey) AS r FROM part) WHERE r <= 40"),
    "T6_top_sum": (lambda s, d: t.top_sum(T(s, d, "lineitem").withColumn("q", c("l_quantity").cast("long")), ["l_suppkey"], "q", 12), "SELECT l_suppkey, CAST(sum(q) AS BIGINT) AS top_sum FROM (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r <= 12 GROUP BY 1"),
    "U1_union_provenance": (lambda s, d: T(s, d, "customer").select(F.lit("customer").alias("source"), c("c_custkey").alias("id")).unionByName(T(s, d, "supplier").select(c("s_suppkey").alias("id"), F.lit("supplier").alias("source"))), "SELECT 'customer' AS source, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier"),
    "U2_distinct_first": (lambda s, d: T(s, d, "part").select("p_partkey", F.array_join(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")), " ").alias("words")), "WITH x AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS l FROM part), y AS (SELECT p_partkey, unnest(l) AS v, unnest(range(len(l))) AS i FROM x), z AS (SELECT p_partkey, v, min(i) AS i FROM y GROUP BY ALL) SELECT p_partkey, string_agg(v, ' ' ORDER BY i) AS words FROM z GROUP BY 1"),
    "U3_set_operations": (lambda s, d: (lambda a, b: a.intersect(b).withColumn("op", F.lit("both")).unionByName(a.exceptAll(b).distinct().withColumn("op", F.lit("left"))).unionByName(b.subtract(a).withColumn("op", F.lit("right"))))(T(s, d, "customer").where("c_acctbal > 5000").select(c("c_nationkey").alias("k")), T(s, d, "supplier").where("s_acctbal > 5000").select(c("s_nationkey").alias("k"))).where("op <> 'left'").unionByName(T(s, d, "customer").where("c_acctbal > 5000").select(c("c_nationkey").alias("k")).subtract(T(s, d, "supplier").where("s_acctbal > 5000").select(c("s_nationkey").alias("k"))).withColumn("op", F.lit("left"))), "WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT k, 'both' AS op FROM (FROM a INTERSECT FROM b) UNION ALL SELECT k, 'left' FROM (FROM a EXCEPT FROM b) UNION ALL SELECT k, 'right' FROM (FROM b EXCEPT FROM a)"),
    "Q1_snapshot_diff": (lambda s, d: t.snapshot_diff(*_old_new(s, d), ["p_partkey"]), f"WITH {_ON}, x AS (SELECT o.p_partkey IS NOT NULL AS oo, m.p_partkey IS NOT NULL AS nn, o.p_brand IS DISTINCT FROM m.p_brand AS d1, o.p_size IS DISTINCT FROM m.p_size AS d2, o.price IS DISTINCT FROM m.price AS d3 FROM o FULL JOIN m ON o.p_partkey = m.p_partkey) SELECT '+' AS \"column\", count(*) FILTER (NOT oo) AS n FROM x UNION ALL SELECT '-', count(*) FILTER (NOT nn) FROM x UNION ALL SELECT '*', count(*) FILTER (oo AND nn AND (d1 OR d2 OR d3)) FROM x UNION ALL SELECT 'p_brand', count(*) FILTER (oo AND nn AND d1) FROM x UNION ALL SELECT 'p_size', count(*) FILTER (oo AND nn AND d2) FROM x UNION ALL SELECT 'price', count(*) FILTER (oo AND nn AND d3) FROM x"),
    "Q2_work_list": (lambda s, d: T(s, d, "customer").join(T(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), _n()), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.when(c("n").isNull(), "new").when(c("n") < 5, "few").when(c("last") >= F.expr("TIMESTAMP_NTZ '2000-06-01'"), "late").otherwise("rest").alias("why")), "SELECT c_custkey, CASE WHEN n IS NULL THEN 'new' WHEN n < 5 THEN 'few' WHEN last >= TIMESTAMP '2000-06-01' THEN 'late' ELSE 'rest' END AS why FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey"),
    "Q6_zone_points": (lambda s, d: T(s, d, "supplier").groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 4).alias("mean"), F.percentile("s_acctbal", F.lit(0.5)).alias("p50"), _n()).orderBy(F.when(c("n") > 3, c("mean")).desc_nulls_last(), "s_nationkey"), "SELECT s_nationkey, round(avg(s_acctbal), 4) AS mean, quantile_cont(s_acctbal, 0.5) AS p50, count(*) AS n FROM supplier GROUP BY 1"),
    "S5_pruned_parquet": (lambda s, d: T(s, d, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '2000-01-01' AND l_quantity > 45").select("l_orderkey", "l_quantity"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_quantity > 45"),
    "Q7_row_groups": (lambda s, d: T(s, d, "orders").where("o_orderkey BETWEEN 1000 AND 1200").select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 1200"),
    "S10_range_scan": (lambda s, d: T(s, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-07'").orderBy("ts", "event_id").select("ts", "event_id", "event_type"), "SELECT ts, event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'"),
    "S11_newest": (lambda s, d: T(s, d, "conversations").where("role = 'user'").orderBy(c("conv_id").desc(), c("turn").desc()).limit(15).select("conv_id", "turn", F.length("text").alias("chars")), "SELECT conv_id, turn, CAST(length(text) AS INT) AS chars FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 15"),
    "revenue_by_nation": (lambda s, d: T(s, d, "lineitem").join(T(s, d, "orders"), c("l_orderkey") == c("o_orderkey")).join(T(s, d, "customer"), c("o_custkey") == c("c_custkey")).join(F.broadcast(T(s, d, "nation")), c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.sum(_rev()).cast("double").alias("revenue"), _n()), f"SELECT n_name, CAST(sum({_REV}) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
}
