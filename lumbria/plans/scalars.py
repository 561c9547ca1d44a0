"""Scalar functions, rules, scores and metrics over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, scoring as sc, text as x
from ..operators import evaluation as ev
from .relational import T

c = F.col


def _dirty(s: SparkSession, d: str) -> DataFrame:
    """Cells with blanks, accents and placeholders made from part names."""
    return T(s, d, "part").select("p_partkey", F.expr("CASE p_partkey % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN concat('  ', p_name, '  x ') WHEN 2 THEN 'CÁMARA Ñusta' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE p_name END").alias("t"))


_DIRTY = "(SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN '  ' || p_name || '  x ' WHEN 2 THEN 'CÁMARA Ñusta' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE p_name END AS t FROM part)"

_HOURS = "CASE n_nationkey % 4 WHEN 0 THEN '10:00 a.m. - 04:30 p.m.' WHEN 1 THEN 'de 9 am a 12 a.m.' WHEN 2 THEN 'todo el día' ELSE '13:00 a.m. - 2 p.m.' END"
_RULES = "CASE p_partkey % 6 WHEN 0 THEN 'fija 12-25..01-06' WHEN 1 THEN 'fija 06-24' WHEN 2 THEN 'nesimo 08 -1 dom' WHEN 3 THEN 'nesimo 05 2 lun 3' WHEN 4 THEN 'mes 11..02' ELSE 'mes 03' END"
_ASK = "CASE n_nationkey % 3 WHEN 0 THEN 'Quiero viajar 5 días en agosto desde Cusco' WHEN 1 THEN 'presupuesto de 1 500 soles en septiembre' ELSE 'algo distinto, 12 dias' END"


def _rain(s, d):
    o = T(s, d, "orders").join(T(s, d, "customer"), c("o_custkey") == c("c_custkey"))
    m = o.groupBy("c_nationkey", F.month("o_orderdate").alias("month")).agg((F.count(F.lit(1)) * 5).cast("double").alias("rain"))
    m = m.withColumn("place", F.rank().over(Window.partitionBy("c_nationkey").orderBy(c("rain").desc())))
    return m.select("c_nationkey", "month", "rain", "place", sc.season_verdict(c("rain"), c("place")).alias("verdict"))


_RAIN = "WITH m AS (SELECT c_nationkey, CAST(month(o_orderdate) AS INT) AS month, CAST(count(*) * 5 AS DOUBLE) AS rain FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), r AS (SELECT *, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY rain DESC) AS INT) AS place FROM m), v AS (SELECT *, CASE WHEN rain >= 150 AND place <= 3 AND rain >= 50 THEN 'desaconsejado' WHEN rain >= 150 OR (place <= 3 AND rain >= 50) THEN 'advertencia' ELSE 'viable' END AS verdict FROM r)"


def _graded(s, d):
    r = T(s, d, "lineitem").select(c("l_orderkey").alias("query"), "l_linenumber", "l_partkey", "l_suppkey", (c("l_quantity").cast("int") % 3).cast("double").alias("grade"))
    p = F.row_number().over(Window.partitionBy("query").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return r.withColumn("p", p).select("query", "grade", F.when(c("p") <= 3, c("p")).alias("place"))


_GRADED = "g AS (SELECT l_orderkey AS query, CAST(CAST(l_quantity AS INT) % 3 AS DOUBLE) AS grade, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem)"


def _raters(s, d):
    return T(s, d, "part").select(c("p_partkey").alias("unit"), F.explode(F.array(c("p_size") % 3, (c("p_size") + c("p_partkey") % 2) % 3, c("p_partkey") % 3)).alias("grade"))


_RATERS = "r AS (SELECT p_partkey AS unit, unnest([p_size % 3, (p_size + p_partkey % 2) % 3, p_partkey % 3]) AS grade FROM part)"


def _bound(s, d):
    l = T(s, d, "lineitem").select("l_orderkey", F.struct((-c("l_extendedprice") / c("l_quantity")).alias("k"), "l_linenumber", "l_partkey", "l_suppkey", c("l_extendedprice").alias("value"), c("l_quantity").alias("cost")).alias("i"))
    return l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("i")).alias("i")).select("l_orderkey", F.round(sc.greedy_bound(c("i"), F.lit(60.0)), 4).alias("bound"))


def _changed(s, d):
    return _rain(s, d).withColumn("later", sc.season_verdict(c("rain") * 1.1, c("place"))).groupBy("verdict", "later").agg(F.count(F.lit(1)).alias("n"))


_MONTHS = "['" + "', '".join(x.MONTHS) + "']"

QUERIES = {
    "F1_cleaned": (lambda s, d: _dirty(s, d).select("p_partkey", x.cleaned(c("t")).alias("t")), f"SELECT p_partkey, CASE WHEN lower(u) NOT IN ('', '-', '--', '---', 'undefined', 'null', 'none', 's/d', 'n/a') THEN u END AS t FROM (SELECT p_partkey, trim(regexp_replace(coalesce(t, ''), '\\s+', ' ', 'g')) AS u FROM {_DIRTY})"),
    "F2_folded": (lambda s, d: _dirty(s, d).select("p_partkey", x.folded(c("t")).alias("t"), x.folded(c("t"), False).alias("u")), f"SELECT p_partkey, replace(lower(t), 'á', 'a') AS t, replace(replace(lower(t), 'á', 'a'), 'ñ', 'n') AS u FROM {_DIRTY}"),
    "F3_controls": (lambda s, d: T(s, d, "part").select("p_partkey", x.without_controls(F.concat("p_name", F.lit("​\u0007 end "))).alias("t")), "SELECT p_partkey, p_name || ' end' AS t FROM part"),
    "F4_redacted": (lambda s, d: T(s, d, "documents").select("doc_id", F.sha2(x.redacted(F.coalesce("text", F.lit(""))), 256).alias("sha")), None),
    "F7_opening_hours": (lambda s, d: T(s, d, "nation").select("n_nationkey", x.opening_hours(F.expr(_HOURS)).alias("h")).select("n_nationkey", "h.opens", "h.closes"), "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '10:00' WHEN 1 THEN '09:00' END AS opens, CASE n_nationkey % 4 WHEN 0 THEN '16:30' WHEN 1 THEN '24:00' END AS closes FROM nation"),
    "F10_point_repair": (lambda s, d: x.with_point(T(s, d, "supplier").select("s_suppkey", F.expr("CASE s_suppkey % 5 WHEN 0 THEN -12.5D WHEN 1 THEN -77.25D WHEN 2 THEN -771234.5D WHEN 3 THEN NULL ELSE 50D END").alias("a"), F.expr("CASE s_suppkey % 5 WHEN 0 THEN -77.25D WHEN 1 THEN -12.5D WHEN 2 THEN -12.5D ELSE 50D END").alias("b")), "a", "b").select("s_suppkey", "point.lat", "point.lon", "point.state"), "SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 3 THEN -12.5::DOUBLE END AS lat, CASE s_suppkey % 5 WHEN 0 THEN -77.25::DOUBLE WHEN 1 THEN -77.25::DOUBLE WHEN 2 THEN -77.12345::DOUBLE END AS lon, ['correct', 'swapped', 'repaired', 'missing', 'invalid'][s_suppkey % 5 + 1] AS state FROM supplier"),
    "F11_title": (lambda s, d: T(s, d, "nation").select("n_nationkey", x.title(F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'Festividad Del Señor De Los Temblores' WHEN 1 THEN 'Playa La Mina' ELSE n_name END")).alias("t")), "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Festividad del Señor de los Temblores' WHEN 1 THEN 'Playa La Mina' ELSE n_name END AS t FROM nation"),
    "F12_shortened": (lambda s, d: T(s, d, "documents").where("lang = 'en'").select("doc_id", F.length(x.shortened(c("text"), 280)).alias("chars")), None),
    "F14_spelling": (lambda s, d: T(s, d, "part").select("p_partkey", x.spelling(c("p_name")).alias("t")), "WITH a AS (SELECT p_partkey, replace(replace(p_name, 'x', 'j'), 'q', 'k') AS t FROM part), b AS (SELECT p_partkey, regexp_replace(regexp_replace(t, 'c([^eih]|$)', 'k\\1', 'g'), 'c([ei])', 's\\1', 'g') AS t FROM a), d AS (SELECT p_partkey, replace(replace(replace(replace(replace(t, 'z', 's'), 'v', 'b'), 'ch', '#'), 'h', ''), '#', 'ch') AS t FROM b), e AS (SELECT p_partkey, replace(replace(t, 'll', 'l'), 'y', 'i') AS t FROM d) SELECT p_partkey, replace(replace(replace(replace(replace(replace(t, 'oo', 'o'), 'ee', 'e'), 'tt', 't'), 'ss', 's'), 'nn', 'n'), 'pp', 'p') AS t FROM e"),
    "F15_token_sets": (lambda s, d: T(s, d, "part").select("p_partkey", F.array_join(x.token_set(F.concat_ws(" ", "p_name", "p_type"), ("ring",)), " ").alias("t")), "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 3 AND w[-1] = 's' THEN w[:-2] ELSE w END), lambda w: w <> 'ring'))), ' ') AS t FROM part"),
    "F16_name_classes": (lambda s, d: T(s, d, "part").select("p_partkey", F.when(c("p_name").rlike(r"\bring\b"), "ring").when(c("p_name").rlike("^small"), "small").otherwise("other").alias("k")), "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\\bring\\b') THEN 'ring' WHEN p_name LIKE 'small%' THEN 'small' ELSE 'other' END AS k FROM part"),
    "F17_formats": (lambda s, d: T(s, d, "part").select("p_partkey", x.clock(c("p_partkey") * 7).alias("clock"), x.duration((c("p_partkey") % 400).cast("double")).alias("took"), x.money(c("p_retailprice") * 1000).alias("price"), x.listed(F.split("p_name", " ")).alias("names")), "SELECT p_partkey, format('{:02d}:{:02d}', (p_partkey * 7 % 1440) // 60, p_partkey * 7 % 60) AS clock, CASE WHEN p_partkey % 400 < 60 THEN (p_partkey % 400) || ' min' WHEN p_partkey % 400 % 60 = 0 THEN (p_partkey % 400 // 60) || ' h' ELSE format('{} h {:02d}', p_partkey % 400 // 60, p_partkey % 400 % 60) END AS took, 'S/' || chr(160) || replace(format('{:,}', CAST(round_even(p_retailprice * 1000, 0) AS BIGINT)), ',', chr(160)) AS price, CASE WHEN len(string_split(p_name, ' ')) = 1 THEN p_name ELSE array_to_string(string_split(p_name, ' ')[:-2], ', ') || ' y ' || string_split(p_name, ' ')[-1] END AS names FROM part"),
    "F22_easter": (lambda s, d: s.range(1583, 2400).select(c("id").alias("year"), dates.easter(c("id").cast("int")).alias("day")), "WITH y AS (SELECT unnest(range(1583, 2400)) AS y), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a), l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h), m AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM l) SELECT y AS year, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS day FROM m"),
    "F23_nth_weekday": (lambda s, d: T(s, d, "orders").select("o_orderkey", dates.nth_weekday(F.year("o_orderdate"), F.month("o_orderdate"), F.when(c("o_orderkey") % 2 == 0, -1).otherwise(2), F.lit(4)).alias("day")), "WITH f AS (SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS f, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS l FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN l - CAST((isodow(l) - 1 - 4 + 7) % 7 AS INT) ELSE f + CAST((4 - (isodow(f) - 1) + 7) % 7 + 7 AS INT) END AS day FROM f"),
    "F24_rule_editions": (lambda s, d: dates.expand_rules(T(s, d, "part").select("p_partkey", F.expr(_RULES).alias("rule")), "rule", F.lit("2025-01-01").cast("date"), F.lit("2025-12-31").cast("date")), "WITH r(k, a, b) AS (VALUES (0, DATE '2024-12-25', DATE '2025-01-06'), (0, DATE '2025-12-25', DATE '2026-01-06'), (1, DATE '2025-06-24', DATE '2025-06-24'), (2, DATE '2025-08-31', DATE '2025-08-31'), (3, DATE '2025-05-12', DATE '2025-05-15'), (4, DATE '2024-11-01', DATE '2025-02-28'), (4, DATE '2025-11-01', DATE '2026-02-28'), (5, DATE '2025-03-01', DATE '2025-03-31')) SELECT p_partkey, " + _RULES + " AS rule, a AS starts, b AS ends FROM part JOIN r ON p_partkey % 6 = k"),
    "F29_fingerprints": (lambda s, d: T(s, d, "part").select("p_partkey", F.sha2(F.concat_ws("|", F.lower("p_name"), "p_brand", c("p_size").cast("string")), 256).alias("id"), F.md5(c("p_name").cast("binary")).alias("path")), "SELECT p_partkey, sha256(lower(p_name) || '|' || p_brand || '|' || p_size) AS id, md5(p_name) AS path FROM part"),
    "F30_templates": (lambda s, d: T(s, d, "supplier").select("s_suppkey", F.format_string("https://example.org/%s/%05d", F.lower(F.lit("Sheet")), c("s_suppkey")).alias("url")), "SELECT s_suppkey, format('https://example.org/sheet/{:05d}', s_suppkey) AS url FROM supplier"),
    "F33_trip_clock": (lambda s, d: T(s, d, "orders").select("o_orderkey", (F.floor((c("o_orderkey") % 1440) / 15) * 15).cast("int").alias("leaves"), (F.ceil((c("o_orderkey") % 1440 + 437) / 5) * 5 % 1440).cast("int").alias("arrives")), "SELECT o_orderkey, CAST((o_orderkey % 1440) // 15 * 15 AS INT) AS leaves, CAST(ceil((o_orderkey % 1440 + 437) / 5) * 5 % 1440 AS INT) AS arrives FROM orders"),
    "F34_requests": (lambda s, d: T(s, d, "nation").select("n_nationkey", x.trip_request(F.expr(_ASK)).alias("r")).select("n_nationkey", "r.month", "r.days", "r.budget", "r.origin"), "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 9 END AS month, CASE n_nationkey % 3 WHEN 0 THEN 5 WHEN 2 THEN 12 END AS days, CASE WHEN n_nationkey % 3 = 1 THEN 1500 END AS budget, CASE WHEN n_nationkey % 3 = 0 THEN 'cusco' END AS origin FROM nation"),
    "F37_month_window": (lambda s, d: T(s, d, "orders").select("o_orderkey", dates.month_window((c("o_orderkey") % 12 + 1).cast("int"), F.to_date("o_orderdate")).alias("w")).select("o_orderkey", "w.starts", "w.ends"), "WITH f AS (SELECT o_orderkey, make_date(year(o_orderdate) + CASE WHEN o_orderkey % 12 + 1 < month(o_orderdate) THEN 1 ELSE 0 END, o_orderkey % 12 + 1, 1) AS starts FROM orders) SELECT o_orderkey, starts, CAST(starts + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS ends FROM f"),
    "P16_bands": (lambda s, d: T(s, d, "part").select("p_partkey", sc.band(c("p_size"), (10, 25, 40), ("low", "mid", "high", "top")).alias("size"), sc.band(c("p_retailprice"), (950.0, 1100.0), ("a", "b", "c"), right=False).alias("price")), "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'low' WHEN p_size <= 25 THEN 'mid' WHEN p_size <= 40 THEN 'high' ELSE 'top' END AS size, CASE WHEN p_retailprice < 950 THEN 'a' WHEN p_retailprice < 1100 THEN 'b' ELSE 'c' END AS price FROM part"),
    "P18_speed_at_hour": (lambda s, d: T(s, d, "part").select("p_partkey", F.round(sc.circle_interpolated((c("p_partkey") % 96) / 4.0, [float(20 + (h * 7) % 30) for h in range(24)]), 6).alias("v")), "WITH h AS (SELECT p_partkey, (p_partkey % 96) / 4.0 AS h FROM part), i AS (SELECT *, CAST(floor(h) AS INT) AS i FROM h) SELECT p_partkey, round(20 + (i * 7) % 30 + ((20 + (((i + 1) % 24) * 7) % 30) - (20 + (i * 7) % 30)) * (h - i), 6)::DOUBLE AS v FROM i"),
    "P19_stop_values": (lambda s, d: T(s, d, "part").select("p_partkey", sc.stop_value(F.expr("IF(p_size % 5 = 0, NULL, p_size % 5)"), F.expr("IF(p_partkey % 10 = 0, 4, NULL)"), F.split("p_name", " "), F.expr("IF(p_partkey % 3 = 0, array('small'), CAST(array() AS array<string>))")).alias("v")), "WITH k AS (SELECT *, greatest(CASE WHEN p_size % 5 > 0 THEN p_size % 5 END, CASE WHEN p_partkey % 10 = 0 THEN 4 END) AS r FROM part) SELECT p_partkey, CASE r WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 6 WHEN 4 THEN 24 ELSE 2 END * CASE WHEN p_partkey % 3 = 0 AND NOT list_contains(string_split(p_name, ' '), 'small') THEN 0.25::DOUBLE ELSE 1 END AS v FROM k"),
    "P20_altitude_rule": (lambda s, d: T(s, d, "part").select("p_partkey", sc.altitude_matters(F.expr("IF(p_partkey % 6 = 0, NULL, p_partkey % 50 * 90)"), F.expr("p_partkey % 30 * 60")).alias("matters")), "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 50 * 90 END >= 2500 AND p_partkey % 50 * 90 - p_partkey % 30 * 60 >= 1000, false) AS matters FROM part"),
    "G24_novelty": (lambda s, d: T(s, d, "part").select("p_partkey", F.round(sc.novelty(c("p_size") / 50, (c("p_partkey") % 10) / 9), 9).alias("v")), "SELECT p_partkey, round(least(1, greatest(0, 0.5 * (1 - p_size / 50) + 0.5 * ((p_partkey % 10) / 9))), 9) AS v FROM part"),
    "G25_route_score": (lambda s, d: T(s, d, "part").select("p_partkey", F.round(sc.route_score(c("p_size") / 50, F.lit(0.75), F.lit(1.0), F.lit(0.9), F.lit(1.0), (c("p_partkey") % 10) / 10, c("p_partkey") % 2 == 0), 9).alias("v")), "SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN 0.5 * (p_size / 50) * 0.75 * 0.9 + 0.5 * ((p_partkey % 10) / 10) ELSE 0.7 * (p_size / 50) * 0.75 * 0.9 + 0.3 * ((p_partkey % 10) / 10) END, 9) AS v FROM part"),
    "G26_season_verdict": (_rain, f"{_RAIN} SELECT c_nationkey, month, rain, place, verdict FROM v"),
    "A36_verdict_changes": (_changed, f"{_RAIN} SELECT verdict, CASE WHEN rain * 1.1 >= 150 AND place <= 3 AND rain * 1.1 >= 50 THEN 'desaconsejado' WHEN rain * 1.1 >= 150 OR (place <= 3 AND rain * 1.1 >= 50) THEN 'advertencia' ELSE 'viable' END AS later, count(*) AS n FROM v GROUP BY ALL"),
    "G45_fly_or_drive": (lambda s, d: T(s, d, "part").select("p_partkey", sc.flies(F.expr("IF(p_partkey % 9 = 0, NULL, p_partkey % 40 * 60)"), F.expr("IF(p_partkey % 5 = 0, NULL, p_partkey % 12 * 60)"), F.lit(2880)).alias("air")), "WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 40 * 60 END AS r, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 12 * 60 END AS a FROM part) SELECT p_partkey, CASE WHEN a IS NULL THEN false WHEN r IS NULL THEN true ELSE r > 960 AND r - a >= 240 AND 2 * a <= 0.4 * 2880 END AS air FROM k"),
    "G41_first_reason": (lambda s, d: T(s, d, "part").select("p_partkey", sc.first_reason((c("p_size") > 45, "high"), (c("p_retailprice") > 1200, "dear"), (c("p_type") == "ECONOMY", "plain")).alias("why")), "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'high' WHEN p_retailprice > 1200 THEN 'dear' WHEN p_type = 'ECONOMY' THEN 'plain' END AS why FROM part"),
    "G42_warnings": (lambda s, d: T(s, d, "part").select("p_partkey", F.array_join(sc.all_reasons((c("p_size") > 25, "large"), (c("p_retailprice") > 1000, "dear"), (c("p_partkey") % 3 == 0, "third"), most=2), "|").alias("w")), "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END, CASE WHEN p_partkey % 3 = 0 THEN 'third' END], lambda x: x IS NOT NULL)[:2], '|') AS w FROM part"),
    "T7_greedy_bound": (_bound, None),
    "G28_ranking_metrics": (lambda s, d: ev.ranking_metrics(_graded(s, d)).select("query", F.round("ndcg", 9).alias("ndcg"), "precision", "misfits", "reciprocal"), f"WITH {_GRADED}, b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC) AS o FROM g) SELECT query, round(coalesce(sum(grade / log2(p + 1)) FILTER (p <= 3) / nullif(sum(grade / log2(o + 1)) FILTER (o <= 3), 0), 0), 9) AS ndcg, count(*) FILTER (p <= 3 AND grade >= 1.5) / 3 AS precision, count(*) FILTER (p <= 3 AND grade < 0.5) / 3 AS misfits, coalesce(1.0::DOUBLE / min(p) FILTER (p <= 3 AND grade >= 1.5), 0) AS reciprocal FROM b GROUP BY query"),
    "W9_rank_discount": (lambda s, d: _graded(s, d).where("place IS NOT NULL").groupBy("query").agg(F.round(F.sum(c("grade") / F.log2(c("place") + 1.0)), 9).alias("dcg")), f"WITH {_GRADED} SELECT query, round(sum(grade / log2(p + 1)), 9) AS dcg FROM g WHERE p <= 3 GROUP BY query"),
    "G30_fleiss_kappa": (lambda s, d: ev.fleiss_kappa(_raters(s, d)).select(F.round("kappa", 9).alias("kappa")), f"WITH {_RATERS}, n AS (SELECT unit, grade, count(*)::DOUBLE AS n FROM r GROUP BY ALL), p AS (SELECT avg(s) AS p FROM (SELECT sum(n * (n - 1)) / 6 AS s FROM n GROUP BY unit)), e AS (SELECT sum(pow(c / t, 2)) AS e FROM (SELECT sum(n) AS c, (SELECT sum(n) FROM n) AS t FROM n GROUP BY grade)) SELECT round((p - e) / (1 - e), 9) AS kappa FROM p, e"),
    "G30_krippendorff_nominal": (lambda s, d: ev.krippendorff_alpha(_raters(s, d), ordinal=False).select(F.round("alpha", 9).alias("alpha")), f"WITH {_RATERS}, n AS (SELECT unit, grade, count(*)::DOUBLE AS n FROM r GROUP BY ALL), o AS (SELECT sum((3 - n) * n / 2) AS o FROM n), m AS (SELECT sum(n) AS c FROM n GROUP BY grade), e AS (SELECT pow(sum(c), 2) - sum(c * c) AS e, sum(c) AS t FROM m) SELECT round(1 - (t - 1) * o / e, 9) AS alpha FROM o, e"),
    "G30_krippendorff_ordinal": (lambda s, d: ev.krippendorff_alpha(_raters(s, d)).select(F.round("alpha", 9).alias("alpha")), f"WITH {_RATERS}, n AS (SELECT unit, grade, count(*)::DOUBLE AS n FROM r GROUP BY ALL), o AS (SELECT a.grade AS c, b.grade AS k, sum(CASE WHEN a.grade = b.grade THEN a.n * (a.n - 1) ELSE a.n * b.n END) / 2 AS o FROM n a JOIN n b USING (unit) GROUP BY 1, 2), v AS (SELECT grade, sum(n) AS n FROM n GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY grade) AS s FROM v), g AS (SELECT x.grade AS c, y.grade AS k, x.n AS nc, y.n AS nk, CASE WHEN x.grade = y.grade THEN 0 ELSE pow(CASE WHEN x.s <= y.s THEN y.s - x.s + x.n ELSE x.s - y.s + y.n END - (x.n + y.n) / 2, 2) END AS d FROM s x, s y) SELECT round(1 - ((SELECT sum(n) FROM v) - 1) * sum(coalesce(o, 0) * d) / sum(nc * nk * d), 9) AS alpha FROM g LEFT JOIN o USING (c, k)"),
    "G29_signed_ranks": (lambda s, d: ev.signed_ranks(T(s, d, "lineitem").withColumn("d", c("l_tax") - c("l_discount")), "d").select("n", F.round("mean", 9).alias("mean"), "wins", "losses", "ties", "w_plus", F.round("z", 6).alias("z")), "WITH d AS (SELECT l_tax - l_discount AS d FROM lineitem), r AS (SELECT *, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2::DOUBLE AS rk, count(*) OVER (PARTITION BY abs(d)) AS t FROM d WHERE d <> 0), w AS (SELECT sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, count(*)::DOUBLE AS m, sum(t::DOUBLE * t - 1) AS same FROM r) SELECT count(*) AS n, round(avg(d), 9) AS mean, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties, any_value(w_plus) AS w_plus, round(any_value((w_plus - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - same / 48)), 6) AS z FROM d, w"),
    "G29_bootstrap": (lambda s, d: ev.bootstrap_interval(T(s, d, "lineitem").withColumn("d", c("l_tax") - c("l_discount")), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "d"), None),
    "G29_compared": (lambda s, d: ev.compared(T(s, d, "nation").select((c("n_nationkey") % 5).cast("double").alias("a"), (c("n_nationkey") * 7 % 4).cast("double").alias("b")), "a", "b", times=2000), None),
    "G31_triangle": (lambda s, d: ev.triangle_excess(T(s, d, "lineitem").select((c("l_orderkey") % 5).alias("g"), (c("l_partkey") % 8).alias("src"), (c("l_suppkey") % 8).alias("dst"), "l_quantity").where("src <> dst").groupBy("g", "src", "dst").agg(F.min("l_quantity").alias("cost")), "g"), "WITH e AS (SELECT l_orderkey % 5 AS g, l_partkey % 8 AS s, l_suppkey % 8 AS d, min(l_quantity) AS c FROM lineitem WHERE l_partkey % 8 <> l_suppkey % 8 GROUP BY ALL) SELECT a.g, max(z.c - a.c - b.c) AS excess FROM e a JOIN e b ON a.g = b.g AND a.d = b.s JOIN e z ON z.g = a.g AND z.s = a.s AND z.d = b.d GROUP BY 1"),
    "A35_usability": (lambda s, d: T(s, d, "part").select("p_partkey", ev.sus_score([((c("p_partkey") * (k + 3)) % 5 + 1) for k in range(10)]).alias("score")), "SELECT p_partkey, (" + " + ".join(f"((p_partkey * {k + 3}) % 5)" if k % 2 == 0 else f"(4 - (p_partkey * {k + 3}) % 5)" for k in range(10)) + ") * 2.5::DOUBLE AS score FROM part"),
}
