"""Indicators, distributions, funnels and forecasts over a usage log.

The log has: id, session, type, ts (no zone, UTC), zone, interests, days, budget, results, duration_ms. Every function is
one plan over it; per-session work is aggregated before it is shuffled, so a session or day of any size costs a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Local time is fixed at UTC-5.
LOCAL = "ts - INTERVAL 5 HOURS"

TRIP = ("detail", "saved", "shared", "printed")
#: Steps of the funnel after the first, in order; a result step needs results.
STEPS = ("form", "search", "answer", "detail", "saved")


def local_ts() -> Column:
    return F.expr(LOCAL)


def local_date() -> Column:
    return local_ts().cast("date")


def share(part: Column, whole: Column) -> Column:
    """Percent, null over an empty base."""
    return F.try_divide(part * F.lit(100.0), whole)


def between_dates(log: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Local dates from first to last, both included and optional, as a range of ts that a scan can skip files by."""
    if first is not None:
        log = log.where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{first} 05:00:00'"))
    if last is not None:
        log = log.where(F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{last} 05:00:00' + INTERVAL 1 DAY"))
    return log


def type_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"))


def session_flags(log: DataFrame) -> DataFrame:
    """One row a session: which types it had, and what else the session views need."""
    has = lambda *t: F.bool_or(F.col("type").isin(*t))
    return log.groupBy("session").agg(
        has("form").alias("form"), has("search").alias("search"), has("answer").alias("answer"), has("detail").alias("detail"),
        has("saved").alias("saved"), has("shared").alias("shared"), has("printed").alias("printed"), has("error").alias("error"),
        has("help", "comment").alias("asked"), F.bool_or((F.col("type") == "answer") & (F.col("results") > 0)).alias("found"),
    )


#: id, group, unit, expression over the sums of totals().
INDICATORS = (
    ("sessions", "use", "", "sessions"),
    ("forms", "use", "", "n_form"),
    ("searches", "search", "", "n_search"),
    ("answers", "search", "", "n_answer"),
    ("answers_with_trips", "search", "", "n_found"),
    ("answers_without_trips", "search", "", "n_empty"),
    ("answer_rate", "search", "%", "try_divide(100.0D * n_found, n_answer)"),
    ("forms_without_search_rate", "search", "%", "try_divide(100.0D * s_form_no_search, s_form)"),
    ("details", "interaction", "", "n_detail"),
    ("detail_rate", "interaction", "%", "try_divide(100.0D * s_detail, sessions)"),
    ("saves", "interaction", "", "n_saved"),
    ("save_rate", "interaction", "%", "try_divide(100.0D * s_saved_detail, s_detail)"),
    ("shares", "interaction", "", "n_shared"),
    ("share_rate", "interaction", "%", "try_divide(100.0D * s_shared_detail, s_detail)"),
    ("prints", "interaction", "", "n_printed"),
    ("help_questions", "interaction", "", "n_help"),
    ("comments", "interaction", "", "n_comment"),
    ("errors", "quality", "", "n_error"),
    ("sessions_with_error", "quality", "", "s_error"),
    ("error_rate", "quality", "%", "try_divide(100.0D * s_error, sessions)"),
    ("latency_median_ms", "quality", "ms", "p50"),
    ("latency_p95_ms", "quality", "ms", "p95"),
    ("days_mean", "preference", "days", "days_mean"),
    ("budget_median", "preference", "money", "budget_median"),
)


def indicators(log: DataFrame) -> DataFrame:
    """The 24 indicators as rows (id, category, unit, value): one pass for events, one for sessions, then unpivoted."""
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    t = F.col("type")
    answer, search = t == "answer", t == "search"
    events = log.agg(
        *(n(t == k).alias(f"n_{k}") for k in ("form", "search", "answer", "detail", "saved", "shared", "printed", "help", "comment", "error")),
        n(answer & (F.coalesce("results", F.lit(0)) > 0)).alias("n_found"),
        n(answer & (F.coalesce("results", F.lit(0)) == 0)).alias("n_empty"),
        F.percentile(F.when(answer, F.col("duration_ms")), F.lit(0.5)).alias("p50"),
        F.percentile(F.when(answer, F.col("duration_ms")), F.lit(0.95)).alias("p95"),
        F.avg(F.when(search, F.col("days"))).alias("days_mean"),
        F.percentile(F.when(search, F.col("budget")), F.lit(0.5)).alias("budget_median"),
    )
    s = session_flags(log).agg(
        F.count(F.lit(1)).alias("sessions"), n(F.col("form")).alias("s_form"), n(F.col("form") & ~F.col("search")).alias("s_form_no_search"),
        n(F.col("detail")).alias("s_detail"), n(F.col("saved") & F.col("detail")).alias("s_saved_detail"), n(F.col("shared") & F.col("detail")).alias("s_shared_detail"),
        n(F.col("error")).alias("s_error"),
    )
    rows = ", ".join(f"named_struct('id', '{i}', 'category', '{g}', 'unit', '{u}', 'value', CAST({e} AS DOUBLE))" for i, g, u, e in INDICATORS)
    return events.crossJoin(s).select(F.expr(f"inline(array({rows}))"))


def session_rates(log: DataFrame) -> DataFrame:
    """Shares of sessions by set: form without search, detail of all, saved and shared of detail, error of all."""
    f = session_flags(log)
    c = lambda x: F.count_if(x)
    d = F.col("detail")
    return f.agg(
        share(c(F.col("form") & ~F.col("search")), c(F.col("form"))).alias("form_no_search"),
        share(c(d), F.count(F.lit(1))).alias("detail"),
        share(c(F.col("saved") & d), c(d)).alias("saved_of_detail"),
        share(c(F.col("shared") & d), c(d)).alias("shared_of_detail"),
        share(c(F.col("error")), F.count(F.lit(1))).alias("error"),
    )


def latency(log: DataFrame) -> DataFrame:
    """n, mean, quantiles by linear interpolation, sample deviation (null under two values), ends."""
    v = F.col("duration_ms").cast("double")
    return log.where("type = 'answer' AND duration_ms IS NOT NULL").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), *(F.percentile(v, F.lit(p)).alias(a) for a, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))),
        F.when(F.count(v) > 1, F.stddev_samp(v)).alias("stddev"), F.min(v).alias("lowest"), F.max(v).alias("highest"),
    )


def histogram(values: DataFrame, col: str, bins: int = 6) -> DataFrame:
    """(bin, low, high, n): equal bins, the last closed at its right end; one bin if all values agree; empty bins stay."""
    v = values.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo IS NOT NULL")
    ends = ends.withColumn("k", F.when(F.col("hi") > F.col("lo"), F.lit(bins)).otherwise(F.lit(1)))
    ends = ends.withColumn("w", F.when(F.col("k") > 1, (F.col("hi") - F.col("lo")) / F.col("k")).otherwise(F.lit(1.0)))
    grid = ends.select("lo", "w", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    counts = v.crossJoin(ends).groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.col("k") - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def heatmap(log: DataFrame) -> DataFrame:
    """All 168 cells (weekday from Monday 0, hour) in local time, empty ones 0."""
    spark = log.sparkSession
    cells = spark.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    n = log.groupBy(F.weekday(local_ts()).alias("weekday"), F.hour(local_ts()).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(n, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def daily(log: DataFrame) -> DataFrame:
    """One row a local day from the first to the last observed, days without events 0; nothing outside that range."""
    n = lambda t: F.count_if(F.col("type") == t)
    per = log.withColumn("day", local_date()).groupBy("day").agg(F.countDistinct("session").alias("sessions"), n("search").alias("searches"), n("detail").alias("details"), n("saved").alias("saves"))
    days = per.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(per, "day", "left").na.fill(0)


def session_states(log: DataFrame) -> DataFrame:
    """Every session's furthest state, the classes excluding each other, saving first."""
    state = (
        F.when(F.col("saved"), "saved").when(F.col("detail") | F.col("shared") | F.col("printed"), "opened").when(F.col("found"), "trips").when(F.col("answer"), "no_trips")
        .when(F.col("error"), "error").when(F.col("search"), "no_answer").when(F.col("form"), "form").when(F.col("asked"), "help").otherwise("visit")
    )
    return session_flags(log).select("session", state.alias("state"))


def state_distribution(log: DataFrame) -> DataFrame:
    n = session_states(log).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return n.select("state", "n", share(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("percent"))


def pareto(counts: DataFrame, name: str = "state", n: str = "n") -> DataFrame:
    """Descending by count, then name; share and cumulative share. counts is a small table of classes."""
    w = Window.orderBy(F.col(n).desc(), name)
    so_far = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(n).over(Window.partitionBy())
    return counts.select(F.row_number().over(w).alias("place"), name, n, share(F.col(n), total).alias("percent"), share(so_far, total).alias("cumulative"))


def funnel(log: DataFrame) -> DataFrame:
    """Sessions by step: a step counts only where the steps before came earlier in the session; answers need results.

    For each step in turn, the first event of it behind that of the step before, in the order (ts, id): windows over the
    session, which may have any number of events.
    """
    step = F.expr("CASE type WHEN 'form' THEN 1 WHEN 'search' THEN 2 WHEN 'answer' THEN IF(results > 0, 3, 0) WHEN 'detail' THEN 4 WHEN 'saved' THEN 5 ELSE 0 END")
    e = log.select("session", F.struct("ts", "id", step.alias("step")).alias("e"))
    w = Window.partitionBy("session")
    for k in range(1, 6):
        behind = F.lit(True) if k == 1 else F.col("e") > F.col(f"k{k - 1}")
        e = e.withColumn(f"k{k}", F.min(F.when((F.col("e.step") == k) & behind, F.col("e"))).over(w))
    reached = sum((F.col(f"k{k}").isNotNull().cast("int") for k in range(1, 6)), F.lit(0))
    per, far = e.groupBy("session").agg(F.max(reached).alias("_far")), F.col("_far")
    counts = per.select(far.alias("far")).agg(F.count(F.lit(1)).alias("c0"), *(F.count_if(F.col("far") >= k).alias(f"c{k}") for k in range(1, 6)))
    rows = ", ".join(f"named_struct('step', {k}, 'name', '{s}', 'sessions', c{k}, 'percent', try_divide(100.0D * c{k}, c0))" for k, s in enumerate(("visit", *STEPS)))
    return counts.select(F.expr(f"inline(array({rows}))"))


def session_measures(log: DataFrame) -> DataFrame:
    """Per session: days and budget of its last search, median latency, number of actions on trips."""
    last = F.max_by(F.struct("days", "budget"), F.when(F.col("type") == "search", F.struct("ts", "id")))
    return log.groupBy("session").agg(
        last.alias("last"), F.percentile(F.when(F.col("type") == "answer", F.col("duration_ms")), F.lit(0.5)).alias("latency"),
        F.count_if(F.col("type").isin(*TRIP)).cast("double").alias("actions"),
    ).select("session", F.col("last.days").cast("double").alias("days"), F.col("last.budget").cast("double").alias("budget"), "latency", "actions")


def correlations(rows: DataFrame, cols: list[str], least: int = 5) -> DataFrame:
    """Pearson's r of every ordered pair over rows that have both; null under `least` rows or for a constant.

    All pairs come from one pass of sums; nothing is joined and no built-in that raises on constants is used.
    """
    aggs = []
    for x in cols:
        for y in cols:
            both = F.col(x).isNotNull() & F.col(y).isNotNull()
            p = f"{x}__{y}"
            aggs += [F.count_if(both).alias(f"n_{p}"), *(F.coalesce(F.sum(F.when(both, e)), F.lit(0.0)).alias(f"{k}_{p}") for k, e in (("x", F.col(x)), ("y", F.col(y)), ("xx", F.col(x) * F.col(x)), ("yy", F.col(y) * F.col(y)), ("xy", F.col(x) * F.col(y))))]
    parts = []
    for x in cols:
        for y in cols:
            p = f"{x}__{y}"
            sx, sy, sxy = (f"(n_{p} * {a}_{p} - {b}_{p} * {c}_{p})" for a, b, c in (("xx", "x", "x"), ("yy", "y", "y"), ("xy", "x", "y")))
            r = f"CASE WHEN n_{p} >= {least} AND {sx} > 1e-9 AND {sy} > 1e-9 THEN greatest(-1.0D, least(1.0D, {sxy} / sqrt({sx} * {sy}))) END"
            parts.append(f"named_struct('x', '{x}', 'y', '{y}', 'n', n_{p}, 'r', {r})")
    return rows.agg(*aggs).select(F.expr(f"inline(array({', '.join(parts)}))"))


def rate_window(log: DataFrame, seconds: int = 60) -> DataFrame:
    """Each event with how many its session had within so many seconds up to it."""
    w = Window.partitionBy("session").orderBy(F.col("at")).rangeBetween(-seconds * 1_000_000, 0)
    return log.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).select("id", "session", F.count(F.lit(1)).over(w).alias("recent"))


def most_common(log: DataFrame, col: str, k: int = 8) -> DataFrame:
    """The k most frequent values; ties go to the value seen first."""
    n = log.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "id")).alias("first"))
    return n.orderBy(F.col("n").desc(), "first", col).limit(k).select(col, "n")


def recent(log: DataFrame, k: int = 8) -> DataFrame:
    return log.orderBy(F.col("ts").desc(), "id").limit(k).select("id", "ts", "type")


def moving_average(series: DataFrame, value: str, days: int = 7, day: str = "day") -> DataFrame:
    """Mean of the last `days` rows and the least-squares line over all. A series has a row a day."""
    i = F.row_number().over(Window.orderBy(day)) - 1
    s = series.select(day, F.col(value).cast("double").alias("v"), i.cast("double").alias("i"))
    line = s.agg(F.regr_slope("v", "i").alias("slope"), F.regr_intercept("v", "i").alias("icept"))
    return s.crossJoin(line).select(day, F.avg("v").over(Window.orderBy(day).rowsBetween(1 - days, 0)).alias("mean"), (F.col("icept") + F.col("slope") * F.col("i")).alias("line"))


def forecast(series: DataFrame, value: str, day: str = "day", horizon: int = 7, least: int = 21) -> DataFrame:
    """(ahead, method, mae, value): two methods, the mean of the last seven days and the linear trend (not under 0), are
    tried on the last seven days; the one with the smaller mean absolute error, the mean at a tie, is refitted on all.
    Empty under `least` days."""
    s = series.select(F.col(value).cast("double").alias("v"), (F.row_number().over(Window.orderBy(day)) - 1).cast("double").alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n")).where(F.col("n") >= least)

    def fitted(rows: DataFrame, past: str) -> DataFrame:
        known = rows.where(past)
        return known.agg(F.regr_slope("v", "i").alias("slope"), F.regr_intercept("v", "i").alias("icept"), F.max("i").alias("end"))

    def mean_last(rows: DataFrame, low: str, high: str) -> DataFrame:
        return rows.where(f"i >= n - {low} AND i < n - {high}").agg(F.avg("v").alias("m"))

    trial = s.where(f"i >= n - {horizon}").crossJoin(fitted(s, f"i < n - {horizon}")).crossJoin(mean_last(s, str(7 + horizon), str(horizon)))
    maes = trial.agg(F.avg(F.abs(F.col("v") - F.col("m"))).alias("mae_mean"), F.avg(F.abs(F.col("v") - F.greatest(F.lit(0.0), F.col("icept") + F.col("slope") * F.col("i")))).alias("mae_line"))
    best = maes.where("mae_mean IS NOT NULL").crossJoin(fitted(s, "true")).crossJoin(mean_last(s, "7", "0")).withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    mean = F.col("mae_mean") <= F.col("mae_line")
    value_ = F.when(mean, F.col("m")).otherwise(F.greatest(F.lit(0.0), F.col("icept") + F.col("slope") * (F.col("end") + F.col("ahead"))))
    return best.select("ahead", F.when(mean, "mean7").otherwise("line").alias("method"), F.least("mae_mean", "mae_line").alias("mae"), value_.alias("value"))
