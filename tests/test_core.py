import datetime
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import verify
from lumbria.functions import dates, scoring, text
from lumbria.operators import evaluation, joins, network, tables, trips, usage
from lumbria.operators.components import connected_components
from lumbria.plans import trips as plan_trips, usage as plan_usage
from lumbria.streaming import log

CORE = sorted(n for n in entry.oracle_sql() if not re.match(r"op\d+_|pipeline", n))


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, small, name):
    assert verify.same(spark, verify.connect(small), name, small).startswith("same")


def test_entry(spark):
    assert entry.entry(spark).count() == 24


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_easter_and_rules(spark):
    known = {1961: (4, 2), 2000: (4, 23), 2008: (3, 23), 2024: (3, 31), 2038: (4, 25), 1818: (3, 22)}
    for y, (m, d) in known.items():
        assert one(spark, dates.easter(F.lit(y))) == datetime.date(y, m, d)
    got = one(spark, dates.rule_dates(F.lit("fija 02-29"), F.lit(2025)))
    assert got.starts == got.ends == datetime.date(2025, 2, 28)
    assert one(spark, dates.rule_dates(F.lit("fija 2-9"), F.lit(2025))).starts is None
    r = spark.createDataFrame([("fija 12-25..01-06",)], "r string")
    a, b = (F.lit(d).cast("date") for d in ("2026-01-02", "2026-01-03"))
    assert [x.starts for x in dates.expand_rules(r, "r", a, b).collect()] == [datetime.date(2025, 12, 25)]


def test_text(spark):
    f = lambda c: one(spark, c)
    assert f(text.folded(F.lit("ÁÑandú"))) == "añandu"
    assert f(text.cleaned(F.lit("  S/D "))) is None
    assert f(text.duration(F.lit(160))) == "2 h 40" and f(text.duration(F.lit(45.0))) == "45 min"
    assert f(text.money(F.lit(1250))) == "S/ 1 250"
    assert f(text.listed(F.array(F.lit("a"), F.lit(""), F.lit("b")))) == "a y b"
    assert f(text.clock(F.lit(1500))) == "01:00" and f(text.minutes_of(F.lit("08:30"), 5)) == 510 and f(text.minutes_of(F.lit("x"), 5)) == 5
    assert f(text.spelling(F.lit("huarihuilca"))) == f(text.spelling(F.lit("wariwilka")))
    assert f(text.redacted(F.lit("a.b@c.pe 987 654 321 12345678"))) == "[email] [phone] [id]"
    assert f(text.shortened(F.lit("Uno. Dos tres. Cuatro cinco."), 16)) == "Uno. Dos tres."
    d = spark.createDataFrame([(-780558.0373798, -6.5)], "a double, b double")
    p = text.with_point(d, "a", "b").first()["point"]
    assert (p.lat, p.lon, p.state) == (-6.5, -78.05580373798, "repaired")


def test_empty_log(spark, small):
    empty = plan_usage.log(spark, small).limit(0)
    got = {r.id: r.value for r in usage.indicators(empty).collect()}
    assert got["sessions"] == 0 and got["answer_rate"] is None and got["latency_p95_ms"] is None
    assert usage.daily(empty).count() == 0 and usage.heatmap(empty).agg(F.sum("n")).first()[0] == 0
    assert usage.funnel(empty).where("percent IS NOT NULL").count() == 0
    assert usage.forecast(usage.daily(empty), "sessions").count() == 0 and usage.histogram(empty, "duration_ms").count() == 0


def test_histogram_of_a_constant_and_correlation_of_one(spark):
    d = spark.createDataFrame([(5.0, float(k)) for k in range(6)], "a double, b double")
    assert [(r.low, r.n) for r in usage.histogram(d, "a").collect()] == [(5.0, 6)]
    got = {(r.x, r.y): (r.n, r.r) for r in usage.correlations(d, ["a", "b"]).collect()}
    assert got[("a", "b")] == (6, None) and got[("b", "b")] == (6, 1.0)
    assert {r.r for r in usage.correlations(d.limit(4), ["b"]).collect()} == {None}


def test_radius_join_has_no_cross_join_and_loses_none(spark):
    pts = [(k, -20 + (k * 7919 % 4000) / 100, 179.5 + (k * 104729 % 100) / 100) for k in range(300)]
    pts = [(k, a, o - 360 if o > 180 else o) for k, a, o in pts]
    d = spark.createDataFrame(pts, "id long, lat double, lon double")
    j = joins.radius_join(d, d.withColumnRenamed("id", "r_id"), 80)
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    cross = d.crossJoin(d.toDF("r_id", "r_lat", "r_lon")).where(joins.haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= 80)
    pair = lambda x: {(r.id, r.r_id) for r in x.select("id", "r_id").collect()}
    assert pair(j) == pair(cross) and j.count() == len(pair(j))


def test_agreement_examples(spark):
    # Krippendorff 2011: two and more raters with gaps; nominal 0.743, ordinal 0.815
    a = [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None], [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3], [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None], [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None]
    d = spark.createDataFrame([(u, r[u]) for r in a for u in range(12)], "unit int, grade int")
    assert round(evaluation.krippendorff_alpha(d, ordinal=False).first()[0], 3) == 0.743
    assert round(evaluation.krippendorff_alpha(d).first()[0], 3) == 0.815


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (200, 200)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 200}


def test_paths_unreachable_and_bounded(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("d", "a", 1.0)], "u string, v string, cost double")
    s = spark.createDataFrame([("a", "a")], "source string, node string")
    assert {r.node: r.cost for r in network.shortest_paths(e, s).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.node for r in network.shortest_paths(e, s, most=1.5).collect()} == {"a", "b"}


def test_day_plan_is_feasible_and_near_the_optimum(spark, small):
    from lumbria.plans.trips import _stops

    stops = _stops(spark, small).where("trip < 6").cache()
    info = {(r.trip, r.stop): r for r in stops.collect()}
    plans = trips.day_plans(stops).collect()
    assert len({(r.trip, r.stop) for r in plans}) == len(plans)
    for r in plans:
        i = info[(r.trip, r.stop)]
        assert i.opens <= r.arrives and r.arrives + i.visit <= i.closes
    orders = trips.visiting_orders(stops).collect()
    assert all(r.two_opt <= r.by_nearest + 1e-9 and r.two_opt <= r.by_value + 1e-9 for r in orders)
    bands = trips.cost_bands(spark.createDataFrame([(1.0,), (2.0,)], "k double"), {"x": (10, 20)}, {"x": "k"}).collect()
    assert bands[0].p20 < bands[0].p50 < bands[0].p80 and bands[1].p50 == pytest.approx(2 * bands[0].p50)


def test_stream_rate_limit_counts_accepted_events_only(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(k, "s", t0 + datetime.timedelta(seconds=20 * k)) for k in range(9)]
    d = spark.createDataFrame(rows, "id long, session string, ts timestamp")
    got = log.run_once(log.rate_limited(log.landed(d, "t", 1), "session", "ts", 2, 60, "id long, session string, ts timestamp"), "t")
    assert sorted(r.id for r in got.collect()) == [0, 1, 3, 4, 6, 7]


def test_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z"), (4, "w")], "k int, v string")
    assert {r["column"]: r.n for r in tables.snapshot_diff(a, b, ["k"]).collect()} == {"+": 1, "-": 1, "*": 1, "v": 1}
    assert one(spark, scoring.greedy_bound(F.expr("array(named_struct('value', 5.0D, 'cost', 3.0D), named_struct('value', 4.0D, 'cost', 9.0D), named_struct('value', 1.0D, 'cost', 2.0D))"), F.lit(5.0))) == 6.0


def test_file_sources(spark, tmp_path):
    from pyspark.sql import types as T

    from lumbria.sources import files

    want = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    (tmp_path / "a.csv").write_text("\ufeffv;k\n\u00f1u;1\nb;2\n", encoding="utf-8")
    assert sorted(map(tuple, files.read_delimited(spark, str(tmp_path / "a.csv"), want, ["k"]).collect())) == [(1, "\u00f1u"), (2, "b")]
    (tmp_path / "b.csv").write_text("v;k\nb;2\nc;2\n")
    with pytest.raises(files.DuplicateKeys):
        files.read_delimited(spark, str(tmp_path / "b.csv"), want, ["k"])
    (tmp_path / "c.csv").write_text("v\nb\n")
    with pytest.raises(files.MissingColumns):
        files.read_delimited(spark, str(tmp_path / "c.csv"), want)
    d = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    a, b = (files.manifest({"d": q}).first()["sha256"] for q in (d, d.orderBy(F.col("k").desc())))
    assert a == b != files.manifest({"d": d.limit(1)}).first()["sha256"]


def test_trips_and_ways_cover_whole_tables(spark):
    d = "/root/testdata/sf0.01"
    customers, lines = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "lineitem"))
    stops = plan_trips._stops(spark, d)
    assert stops.select("stop").distinct().count() == customers.count()
    assert stops.groupBy("trip").count().agg(F.max("count")).first()[0] <= 10
    assert plan_trips._ways(spark, d).select("way").distinct().count() == lines.select("l_orderkey").distinct().count()
    assert plan_trips.QUERIES["G16_exact_day"][0](spark, d).count() == stops.select("trip").distinct().count()


def test_exact_day_drops_no_stops(spark):
    """A trip that is too large to be searched has no answer, and doesn't keep others from theirs."""
    stops = plan_trips._stops(spark, "/root/testdata/sf0.001").where("stop < 15").withColumn("trip", F.lit(0).cast("long"))
    both = stops.unionByName(stops.withColumn("stop", F.col("stop") + 100)).unionByName(stops.where("stop < 3").withColumn("trip", F.lit(1).cast("long")))
    got = {r.trip: r.best for r in trips.exact_day(both).collect()}
    assert got[0] is None and got[1] > 0
