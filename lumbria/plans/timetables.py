"""Timetables of the orders' routes: a line of an order is a stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timetable as tt
from .relational import T

c = F.col

_STOP = """struct(l_linenumber, l_partkey, l_suppkey, l_partkey AS stop, CASE WHEN l_partkey % 97 > 0 THEN CAST(5 + l_partkey % 50 + l_suppkey % 3 * 25 AS DOUBLE) END AS leg, 15 + l_suppkey % 75 AS visit,
480 + l_partkey % 6 * 45 AS opens, 900 + l_suppkey % 7 * 60 AS closes, l_partkey % 9 = 0 AS minor, CASE WHEN l_suppkey % 4 = 0 THEN array(l_partkey % 7, (l_partkey + 2) % 7, (l_partkey + 3) % 7, (l_partkey + 5) % 7) END AS weekdays, l_suppkey % 3 = 0 AS food)"""


def routes(s: SparkSession, d: str) -> DataFrame:
    k = c("l_orderkey")
    out = T(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.expr(_STOP))).alias("stops"))
    day = F.when(k % 5 > 0, k % 7).alias("weekday")
    return out.select(k.alias("route"), "stops", (420 + k % 9 * 45).alias("start"), (480 + k % 4 * 60).alias("cap"), day, (k % 2 == 0).alias("food"), (10 + k % 100).cast("double").alias("back"))


def _listed(s: SparkSession, d: str) -> DataFrame:
    p = c("plan")
    rows = tt.timetables(routes(s, d))
    return rows.select("route", p.isNotNull().alias("made"), p["leaves"].alias("leaves"), p["returns"].alias("returns"), p["minutes"].alias("minutes"), p["lunch"]["after"].alias("lunch_after"), p["lunch"]["at"].alias("lunch_at"), p["lunch"]["stop"].alias("lunch_stop"), F.expr("array_join(transform(plan.visits, v -> concat_ws(':', v.stop, v.arrives, v.waits)), ',')").alias("visits"))


#: A row per stop, walked along by recursion; the moments of a stop are columns, one select after another.
_SQL = """WITH RECURSIVE r AS (SELECT l_orderkey AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS k, l_partkey AS stop,
 CASE WHEN l_partkey % 97 > 0 THEN 5 + l_partkey % 50 + l_suppkey % 3 * 25 END AS leg, 15 + l_suppkey % 75 AS visit, 480 + l_partkey % 6 * 45 AS opens, 900 + l_suppkey % 7 * 60 AS closes, l_partkey % 9 = 0 AS minor,
 l_suppkey % 4 = 0 AND l_orderkey % 5 > 0 AND (l_orderkey - l_partkey) % 7 NOT IN (0, 2, 3, 5, -7, -5, -4, -2) AS shut, l_suppkey % 3 = 0 AS food, 420 + l_orderkey % 9 * 45 AS start, 480 + l_orderkey % 4 * 60 AS cap, 10 + l_orderkey % 100 AS back, l_orderkey % 2 = 0 AS base_food FROM lineitem),
s AS (SELECT *, lag(minor, 1, false) OVER w OR minor AS short, CASE WHEN i = k THEN back ELSE lead(leg) OVER w END AS leg2, CASE WHEN i = k THEN 0 ELSE lead(visit) OVER w END AS visit2, CASE WHEN i = k THEN 0 ELSE lead(opens) OVER w END AS opens2, CASE WHEN i = k THEN 1000000 ELSE lead(closes) OVER w END AS closes2, CASE WHEN i = k THEN base_food ELSE lead(food) OVER w END AS food2 FROM r WINDOW w AS (PARTITION BY route ORDER BY i)),
b0 AS (SELECT *, coalesce(greatest(start, opens - leg), start) AS l0 FROM s WHERE i = 1),
b1 AS (SELECT *, CASE WHEN l0 >= 750 THEN greatest(start, 750) WHEN l0 >= 690 AND l0 + leg > 840 THEN greatest(start, 690) END AS m FROM b0),
b AS (SELECT route, l0 + CASE WHEN m + 60 > l0 THEN 60 ELSE 0 END AS leaves, CASE WHEN m + 60 <= l0 THEN m WHEN m IS NOT NULL THEN l0 END AS meal FROM b1),
w AS (
 SELECT route, 0::BIGINT AS i, true AS ok, leaves, leaves AS now, meal, CASE WHEN meal IS NOT NULL THEN 0 END::BIGINT AS after, NULL::BIGINT AS lstop, false AS inside, false AS promised, '' AS visits FROM b
 UNION ALL
 SELECT route, i, ok AND coalesce((leg <= 90 OR NOT short) AND NOT shut AND opens - t1 <= 60 AND e <= closes, false), leaves, CASE WHEN eat2 THEN e + 60 ELSE e END, CASE WHEN eat2 THEN e ELSE meal1 END, CASE WHEN eat2 THEN i ELSE after1 END, CASE WHEN eat2 THEN stop ELSE lstop1 END, inside1 OR eat2,
  hungry AND e >= 750 AND NOT eat2 AND fits2 AND i < k, visits || CASE WHEN i > 1 THEN ',' ELSE '' END || concat_ws(':', stop, t1, greatest(opens - t1, 0))
 FROM (SELECT *, coalesce(hungry AND (late2 OR (e >= 750 AND (food OR NOT food2))), false) AS eat2 FROM (
  SELECT *, n2 > 840 OR (greatest(n2, opens2) + visit2 > 840 AND NOT fits2) AS late2 FROM (
   SELECT *, greatest(n2 + 60, opens2) + visit2 <= closes2 AS fits2 FROM (
    SELECT *, e + coalesce(leg2, 0) AS n2, meal1 IS NULL AND e >= 690 AS hungry FROM (
     SELECT *, greatest(t1, opens) + visit AS e FROM (
      SELECT *, t + CASE WHEN eat1 THEN 60 ELSE 0 END AS t1, CASE WHEN eat1 THEN t ELSE meal END AS meal1, CASE WHEN eat1 THEN i - 1 ELSE after END AS after1, CASE WHEN eat1 THEN stop ELSE lstop END AS lstop1, inside OR eat1 AS inside1 FROM (
       SELECT *, coalesce(meal IS NULL AND (promised OR t > 840 OR (t >= 690 AND (opens - t >= 60 OR (greatest(t, opens) + visit > 840 AND greatest(t + 60, opens) + visit <= closes)))), false) AS eat1 FROM (
        SELECT s.*, w.ok, w.leaves, w.meal, w.after, w.lstop, w.inside, w.promised, w.visits, w.now + s.leg AS t FROM w JOIN s ON s.route = w.route AND s.i = w.i + 1 WHERE w.ok))))))))),
z AS (SELECT w.*, s.start, s.cap, s.k, s.minor, s.back, w.now + s.back AS returns FROM w JOIN s ON s.route = w.route AND s.i = w.i WHERE w.ok AND w.i = s.k),
y AS (SELECT *, returns - leaves - CASE WHEN inside THEN 60 ELSE 0 END AS minutes FROM z),
x AS (SELECT * FROM y WHERE (back <= 90 OR NOT minor) AND minutes <= cap AND returns <= start + cap + 60)
SELECT o.route, x.route IS NOT NULL AS made, leaves, returns, minutes, CAST(CASE WHEN meal IS NULL AND returns >= 750 THEN k ELSE after END AS INT) AS lunch_after, CASE WHEN meal IS NULL AND returns >= 750 THEN returns ELSE meal END AS lunch_at, lstop AS lunch_stop, visits FROM (SELECT DISTINCT route FROM r) o LEFT JOIN x USING (route)"""

QUERIES = {"G15_timetables": (_listed, _SQL)}
