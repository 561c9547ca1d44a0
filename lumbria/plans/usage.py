"""Usage analytics over the events table, which stands in for a usage log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage as u

_TYPE = "CASE event_type WHEN 'signup' THEN 'form' WHEN 'view' THEN 'search' WHEN 'click' THEN 'answer' WHEN 'purchase' THEN CASE WHEN k % 5 < 2 THEN 'detail' WHEN k % 5 = 2 THEN 'saved' WHEN k % 5 = 3 THEN 'shared' ELSE 'printed' END ELSE CASE k % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'help' WHEN 2 THEN 'comment' ELSE 'visit' END END"


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions are a user's local days; what the table lacks is derived from k, the number in props."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("k", F.from_json("props", "k INT")["k"])
    session = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(F.expr(u.LOCAL), "yyyyMMdd"))
    e = e.select("event_id", "ts", "value", "k", "event_type", session.alias("session"), F.expr(_TYPE).alias("type"))
    when = lambda t, c: F.when(F.col("type") == t, F.expr(c))
    return e.select(
        F.col("event_id").alias("id"), "session", "type", "ts", when("detail", "k % 20").alias("zone"),
        when("search", "filter(array('nature', 'culture', 'food', 'coast'), (x, i) -> shiftright(k, i) % 2 = 1)").alias("interests"),
        when("search", "IF(k % 10 = 0, NULL, k % 7 + 1)").alias("days"), when("search", "IF(k % 3 = 0, NULL, 100 * (k % 9 + 1))").alias("budget"),
        when("answer", "k % 4").alias("results"), when("answer", "IF(k % 7 = 0, NULL, CAST(floor(value * 100) AS INT))").alias("duration_ms"),
    )


_LOG = f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
t AS (SELECT *, CAST(user_id AS VARCHAR) || '-' || strftime(ts - INTERVAL 5 HOURS, '%Y%m%d') AS session, {_TYPE} AS type FROM e),
log AS (SELECT event_id AS id, session, type, ts, CASE WHEN type = 'detail' THEN k % 20 END AS zone,
  CASE WHEN type = 'search' THEN list_concat(list_concat(CASE WHEN k % 2 = 1 THEN ['nature'] ELSE [] END, CASE WHEN (k // 2) % 2 = 1 THEN ['culture'] ELSE [] END), list_concat(CASE WHEN (k // 4) % 2 = 1 THEN ['food'] ELSE [] END, CASE WHEN (k // 8) % 2 = 1 THEN ['coast'] ELSE [] END)) END AS interests,
  CASE WHEN type = 'search' AND k % 10 <> 0 THEN k % 7 + 1 END AS days, CASE WHEN type = 'search' AND k % 3 <> 0 THEN 100 * (k % 9 + 1) END AS budget,
  CASE WHEN type = 'answer' THEN k % 4 END AS results, CASE WHEN type = 'answer' AND k % 7 <> 0 THEN CAST(floor(value * 100) AS INT) END AS duration_ms FROM t),
fl AS (SELECT session, bool_or(type = 'form') AS form, bool_or(type = 'search') AS search, bool_or(type = 'answer') AS answer, bool_or(type = 'detail') AS detail, bool_or(type = 'saved') AS saved,
  bool_or(type = 'shared') AS shared, bool_or(type = 'printed') AS printed, bool_or(type = 'error') AS error, bool_or(type IN ('help', 'comment')) AS asked, bool_or(type = 'answer' AND results > 0) AS found FROM log GROUP BY session)
"""

_STATE = "CASE WHEN saved THEN 'saved' WHEN detail OR shared OR printed THEN 'opened' WHEN found THEN 'trips' WHEN answer THEN 'no_trips' WHEN error THEN 'error' WHEN search THEN 'no_answer' WHEN form THEN 'form' WHEN asked THEN 'help' ELSE 'visit' END"
_SUMS = """ev AS (SELECT count(*) FILTER (type = 'form') AS n_form, count(*) FILTER (type = 'search') AS n_search, count(*) FILTER (type = 'answer') AS n_answer, count(*) FILTER (type = 'detail') AS n_detail,
  count(*) FILTER (type = 'saved') AS n_saved, count(*) FILTER (type = 'shared') AS n_shared, count(*) FILTER (type = 'printed') AS n_printed, count(*) FILTER (type = 'help') AS n_help, count(*) FILTER (type = 'comment') AS n_comment,
  count(*) FILTER (type = 'error') AS n_error, count(*) FILTER (type = 'answer' AND coalesce(results, 0) > 0) AS n_found, count(*) FILTER (type = 'answer' AND coalesce(results, 0) = 0) AS n_empty,
  quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95, avg(days) AS days_mean, quantile_cont(budget, 0.5) AS budget_median FROM log),
se AS (SELECT count(*) AS sessions, count(*) FILTER (form) AS s_form, count(*) FILTER (form AND NOT search) AS s_form_no_search, count(*) FILTER (detail) AS s_detail, count(*) FILTER (saved AND detail) AS s_saved_detail,
  count(*) FILTER (shared AND detail) AS s_shared_detail, count(*) FILTER (error) AS s_error FROM fl)
"""


def _indicator_sql() -> str:
    import re

    rows = " UNION ALL ".join(f"SELECT '{i}' AS id, '{g}' AS category, '{n}' AS unit, CAST({re.sub(r'try_divide\((.*), (.*)\)', r'(\1) / nullif(\2, 0)', e).replace('100.0D', '100.0')} AS DOUBLE) AS value FROM ev, se" for i, g, n, e in u.INDICATORS)
    return f"{_LOG}, {_SUMS} {rows}"


def _daily_sql(inner: str) -> str:
    return f"""{_LOG}, per AS (SELECT CAST(ts - INTERVAL 5 HOURS AS DATE) AS day, count(DISTINCT session) AS sessions, count(*) FILTER (type = 'search') AS searches, count(*) FILTER (type = 'detail') AS details, count(*) FILTER (type = 'saved') AS saves FROM log GROUP BY 1),
days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM per),
d AS (SELECT day, coalesce(sessions, 0) AS sessions, coalesce(searches, 0) AS searches, coalesce(details, 0) AS details, coalesce(saves, 0) AS saves FROM days LEFT JOIN per USING (day)) {inner}"""


def _corr_sql() -> str:
    cols = ["days", "budget", "latency", "actions"]
    m = f"""{_LOG}, m AS (SELECT session, arg_max(CASE WHEN type = 'search' THEN {{'d': days, 'b': budget}} END, CASE WHEN type = 'search' THEN {{'t': ts, 'i': id}} END) AS last,
      quantile_cont(CASE WHEN type = 'answer' THEN duration_ms END, 0.5) AS latency, CAST(count(*) FILTER (type IN ('detail', 'saved', 'shared', 'printed')) AS DOUBLE) AS actions FROM log GROUP BY session),
    r AS (SELECT session, CAST(last.d AS DOUBLE) AS days, CAST(last.b AS DOUBLE) AS budget, latency, actions FROM m)"""
    return m + " UNION ALL ".join(f" SELECT '{x}' AS x, '{y}' AS y, count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n, CASE WHEN count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) >= 5 THEN round(corr({x}, {y}), 6) END AS r FROM r " for x in cols for y in cols)


def _state_counts(s, d):
    return u.state_distribution(log(s, d))


QUERIES = {
    "A1_type_counts": (lambda s, d: u.type_counts(log(s, d)), f"{_LOG} SELECT type, count(*) AS n, count(DISTINCT session) AS sessions FROM log GROUP BY type"),
    "A2_indicators": (lambda s, d: u.indicators(log(s, d)), _indicator_sql()),
    "A3_session_rates": (lambda s, d: u.session_rates(log(s, d)), f"{_LOG}, {_SUMS} SELECT 100.0 * s_form_no_search / s_form AS form_no_search, 100.0 * s_detail / sessions AS detail, 100.0 * s_saved_detail / s_detail AS saved_of_detail, 100.0 * s_shared_detail / s_detail AS shared_of_detail, 100.0 * s_error / sessions AS error FROM se"),
    "A4_percentiles": (lambda s, d: log(s, d).where("type = 'answer'").groupBy(u.local_date().alias("day")).agg(F.percentile("duration_ms", F.lit(0.5)).alias("p50"), F.percentile("duration_ms", F.lit(0.95)).alias("p95")), f"{_LOG} SELECT CAST(ts - INTERVAL 5 HOURS AS DATE) AS day, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95 FROM log WHERE type = 'answer' GROUP BY 1"),
    "A5_latency": (lambda s, d: u.latency(log(s, d)).withColumn("stddev", F.round("stddev", 6)), f"{_LOG} SELECT count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95, round(stddev_samp(v), 6) AS stddev, min(v) AS lowest, max(v) AS highest FROM (SELECT CAST(duration_ms AS DOUBLE) AS v FROM log WHERE type = 'answer' AND duration_ms IS NOT NULL)"),
    "A6_histogram": (lambda s, d: u.histogram(log(s, d).where("type = 'answer'"), "duration_ms"), f"{_LOG}, v AS (SELECT CAST(duration_ms AS DOUBLE) AS v FROM log WHERE type = 'answer' AND duration_ms IS NOT NULL), ends AS (SELECT min(v) AS lo, (max(v) - min(v)) / 6 AS w FROM v), c AS (SELECT CAST(least(floor((v - lo) / w), 5) AS INT) AS bin, count(*) AS n FROM v, ends GROUP BY 1) SELECT CAST(b AS INT) AS bin, lo + b * w AS low, lo + (b + 1) * w AS high, coalesce(n, 0) AS n FROM (SELECT unnest(range(6)) AS b) g CROSS JOIN ends LEFT JOIN c ON c.bin = g.b"),
    "A7_heatmap": (lambda s, d: u.heatmap(log(s, d)), f"{_LOG}, c AS (SELECT isodow(ts - INTERVAL 5 HOURS) - 1 AS w, hour(ts - INTERVAL 5 HOURS) AS h, count(*) AS n FROM log GROUP BY 1, 2) SELECT CAST(a AS INT) AS weekday, CAST(b AS INT) AS hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(7)) AS a) x CROSS JOIN (SELECT unnest(range(24)) AS b) y LEFT JOIN c ON w = a AND h = b"),
    "A8_daily": (lambda s, d: u.daily(log(s, d)), _daily_sql("SELECT * FROM d")),
    "A9_session_states": (_state_counts, f"{_LOG}, s AS (SELECT {_STATE} AS state FROM fl) SELECT state, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM s) AS percent FROM s GROUP BY state"),
    "A10_pareto": (lambda s, d: u.pareto(_state_counts(s, d).where("state <> 'saved'").select("state", "n")), f"{_LOG}, s AS (SELECT {_STATE} AS state, count(*) AS n FROM fl GROUP BY 1 HAVING state <> 'saved') SELECT CAST(row_number() OVER w AS INT) AS place, state, n, 100.0 * n / sum(n) OVER () AS percent, 100.0 * sum(n) OVER (ORDER BY n DESC, state ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS cumulative FROM s WINDOW w AS (ORDER BY n DESC, state)"),
    "A11_funnel": (lambda s, d: u.funnel(log(s, d)), f"""{_LOG}, q AS (SELECT session, ts, id, CASE WHEN type = 'form' THEN 1 WHEN type = 'search' THEN 2 WHEN type = 'answer' AND results > 0 THEN 3 WHEN type = 'detail' THEN 4 WHEN type = 'saved' THEN 5 END AS st FROM log),
        f1 AS (SELECT session, min((ts, id)) AS t FROM q WHERE st = 1 GROUP BY 1), f2 AS (SELECT q.session, min((q.ts, q.id)) AS t FROM q JOIN f1 ON q.session = f1.session WHERE st = 2 AND (q.ts, q.id) > f1.t GROUP BY 1),
        f3 AS (SELECT q.session, min((q.ts, q.id)) AS t FROM q JOIN f2 ON q.session = f2.session WHERE st = 3 AND (q.ts, q.id) > f2.t GROUP BY 1), f4 AS (SELECT q.session, min((q.ts, q.id)) AS t FROM q JOIN f3 ON q.session = f3.session WHERE st = 4 AND (q.ts, q.id) > f3.t GROUP BY 1),
        f5 AS (SELECT q.session, min((q.ts, q.id)) AS t FROM q JOIN f4 ON q.session = f4.session WHERE st = 5 AND (q.ts, q.id) > f4.t GROUP BY 1),
        c AS (SELECT 0 AS step, 'visit' AS name, count(DISTINCT session) AS sessions FROM log UNION ALL SELECT 1, 'form', count(*) FROM f1 UNION ALL SELECT 2, 'search', count(*) FROM f2 UNION ALL SELECT 3, 'answer', count(*) FROM f3 UNION ALL SELECT 4, 'detail', count(*) FROM f4 UNION ALL SELECT 5, 'saved', count(*) FROM f5)
        SELECT step, name, sessions, 100.0 * sessions / (SELECT sessions FROM c WHERE step = 0) AS percent FROM c"""),
    "A12_correlations": (lambda s, d: u.correlations(u.session_measures(log(s, d)), ["days", "budget", "latency", "actions"]).withColumn("r", F.round("r", 6)), _corr_sql()),
    "A13_last_search": (lambda s, d: u.session_measures(log(s, d)).where("days IS NOT NULL AND budget IS NOT NULL").select("session", "days", "budget"), _corr_sql().split(" SELECT 'days'")[0] + " SELECT session, days, budget FROM r WHERE days IS NOT NULL AND budget IS NOT NULL"),
    "W2_running_total": (lambda s, d: u.daily(log(s, d)).select("day", F.sum("sessions").over(u.Window.orderBy("day").rowsBetween(u.Window.unboundedPreceding, 0)).alias("so_far")), _daily_sql("SELECT day, CAST(sum(sessions) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM d")),
    "W8_rate_window": (lambda s, d: u.rate_window(log(s, d), 3600), f"{_LOG} SELECT id, session, count(*) OVER (PARTITION BY session ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM log"),
    "W11_moving_average": (lambda s, d: u.moving_average(u.daily(log(s, d)), "sessions").select("day", "mean", F.round("line", 6).alias("line")), _daily_sql(", n AS (SELECT day, sessions AS v, row_number() OVER (ORDER BY day) - 1 AS i FROM d) SELECT day, avg(v) OVER (ORDER BY day ROWS 6 PRECEDING) AS mean, round((SELECT regr_intercept(v, i) FROM n) + (SELECT regr_slope(v, i) FROM n) * i, 6) AS line FROM n")),
    "T2_most_common": (lambda s, d: u.most_common(log(s, d), "zone"), f"{_LOG} SELECT zone, count(*) AS n FROM log WHERE zone IS NOT NULL GROUP BY zone ORDER BY n DESC, min((ts, id)) LIMIT 8"),
    "T3_recent": (lambda s, d: u.recent(log(s, d)), f"{_LOG} SELECT id, ts, type FROM log ORDER BY ts DESC, id LIMIT 8"),
    "A23_interest_counts": (lambda s, d: log(s, d).where("type = 'search'").select(F.explode("interests").alias("interest")).groupBy("interest").agg(F.count(F.lit(1)).alias("n")), f"{_LOG} SELECT interest, count(*) AS n FROM (SELECT unnest(interests) AS interest FROM log WHERE type = 'search') GROUP BY interest"),
    "P6_date_range": (lambda s, d: u.between_dates(log(s, d), "2024-01-10", "2024-01-12").groupBy("type").agg(F.count(F.lit(1)).alias("n")), f"{_LOG} SELECT type, count(*) AS n FROM log WHERE CAST(ts - INTERVAL 5 HOURS AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY type"),
    "F31_json": (lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.to_json(F.struct(F.from_json("props", "k INT")["k"].alias("k"), F.col("event_type").alias("type"))).alias("payload"), F.get_json_object("props", "$.k").cast("int").alias("k")), """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS payload, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"""),
    "F32_local_time": (lambda s, d: log(s, d).select("id", u.local_date().alias("day"), F.hour(u.local_ts()).alias("hour")), f"{_LOG} SELECT id, CAST(ts - INTERVAL 5 HOURS AS DATE) AS day, CAST(hour(ts - INTERVAL 5 HOURS) AS INT) AS hour FROM log"),
    "G27_forecast": (lambda s, d: u.forecast(u.daily(log(s, d)), "sessions").select("ahead", "method", F.round("mae", 6).alias("mae"), F.round("value", 6).alias("value")), _daily_sql(""", s AS (SELECT CAST(sessions AS DOUBLE) AS v, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d),
        tr AS (SELECT regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM s WHERE i < n - 7), tm AS (SELECT avg(v) AS m FROM s WHERE i >= n - 14 AND i < n - 7),
        er AS (SELECT avg(abs(v - m)) AS e1, avg(abs(v - greatest(0, a + b * i))) AS e2 FROM s, tr, tm WHERE i >= n - 7), fa AS (SELECT regr_slope(v, i) AS b, regr_intercept(v, i) AS a, max(n) AS n FROM s), fm AS (SELECT avg(v) AS m FROM s WHERE i >= n - 7)
        SELECT CAST(h AS INT) AS ahead, CASE WHEN e1 <= e2 THEN 'mean7' ELSE 'line' END AS method, round(least(e1, e2), 6) AS mae, round(CASE WHEN e1 <= e2 THEN m ELSE greatest(0, a + b * (n - 1 + h)) END, 6) AS value FROM er, fa, fm, (SELECT unnest(range(1, 8)) AS h) hh WHERE n >= 21""")),
}
