"""The bounded trip search against planning every zone."""

from pyspark.sql import functions as F

from lumbria.operators import planned
from lumbria.operators.search import judged
from lumbria.plans import travel as tv


def test_same_as_planning_all(spark):
    d = "/root/testdata/sf0.01"
    q = tv.questions(spark, d).where("query < 8")
    z, t = tv.with_places(spark, d)
    args = (q, z, tv.access(spark, d), t, tv.seasons(spark, d))
    some, work = planned.planned_trips(*args, first=2)
    every, all_work = planned.planned_trips(*args, first=10**6)
    got, want = (sorted(map(str, x.collect())) for x in (some, every))
    assert got == want and len(got) > 8
    w, a = work.collect(), all_work.collect()
    assert sum(x.planned for x in a) == sum(x.zones for x in a)
    assert sum(x.planned for x in w) < 0.75 * sum(x.zones for x in w)
    rows = some.collect()
    assert all(len({r.base for r in rows if r["query"] == k}) == len([r for r in rows if r["query"] == k]) for k in range(8))
    good = judged(*args[:4]).where("reason IS NULL").select("query", "zone")
    assert some.join(good, ["query", "zone"], "left_anti").count() == 0


def test_bounds_hold(spark):
    d = "/root/testdata/sf0.01"
    z, t = tv.with_places(spark, d)
    good = judged(tv.questions(spark, d).where("query < 3"), z, tv.access(spark, d), t).where("reason IS NULL")
    c = planned.candidates(good, t)
    plans = c.groupBy("query", "zone").applyInPandas(planned._planned, "query long, zone long, value double, routes array<array<long>>")
    both = plans.join(planned.bounds(c), ["query", "zone"]).collect()
    assert both and all(r.value <= r.bound + 1e-9 for r in both)


def test_no_zone_at_all(spark):
    d = "/root/testdata/sf0.001"
    z, t = tv.with_places(spark, d)
    trips, work = planned.planned_trips(tv.questions(spark, d), z.where(F.lit(False)), tv.access(spark, d), t, tv.seasons(spark, d))
    assert trips.count() == 0 and work.count() == 0
