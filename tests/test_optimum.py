"""Exact plans against every order of every set."""

import random
import time
from itertools import combinations, permutations

import numpy as np
import pytest

from lumbria.operators import optimum as op
from lumbria.operators import trips as tr


def instance(seed, n):
    r = random.Random(seed)
    lat, lon = (np.array([0.0] + [r.uniform(-0.4, 0.4) for _ in range(n)]) for _ in range(2))
    opens = np.array([0.0] + [r.choice([360.0, 540.0, 660.0, 840.0]) for _ in range(n)])
    closes = np.minimum(opens + np.array([1440.0] + [r.choice([120.0, 300.0, 600.0]) for _ in range(n)]), 1440)
    visit = np.array([0.0] + [float(r.randint(30, 150)) for _ in range(n)])
    value = np.array([0.0] + [float(r.randint(1, 9)) for _ in range(n)])
    return tr.Day(480, 600, tr.minutes_between(lat, lon), visit, opens, closes), value, ["", *(r.choice("abc") for _ in range(n))]


def held(day, n):
    out = {()}
    for size in range(1, min(n, tr.PER_DAY) + 1):
        for own in combinations(range(1, n + 1), size):
            if any(day.arrivals(list(o)) for o in permutations(own)):
                out.add(own)
    return out


def worth(own, value, kind):
    total = 0.0
    for k in {kind[s] for s in own}:
        total += sum(v * tr.REPEAT**i for i, v in enumerate(sorted((value[s] for s in own if kind[s] == k), reverse=True)))
    return total


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("days", [1, 2, 3])
def test_best_plan(seed, days):
    day, value, kind = instance(seed, 6)
    sets = held(day, 6)
    got, whole = op.day_sets(day)
    assert whole and {tuple(sorted(r)) for r in got.values()} == sets
    reach = {()}
    for _ in range(days):
        reach = {tuple(sorted((*a, *b))) for a in reach for b in sets if not set(a) & set(b)}
    best, bound, routes = op.best_plan(day, days, value, kind)
    assert best == pytest.approx(max(worth(x, value, kind) for x in reach)) and bound == best
    used = [s for r in routes for s in r]
    assert len(routes) == days and len(set(used)) == len(used) and worth(used, value, kind) == pytest.approx(best)
    assert all(not r or day.arrivals(r) for r in routes)


def test_a_third_stop_makes_two_fit():
    """Straight from the first to the second would be a wait of over an hour; with the third between them it is not."""
    travel = np.array([[0, 10, 20, 15], [10, 0, 10, 5], [20, 10, 0, 5], [15, 5, 5, 0]], float)
    day = tr.Day(480, 480, travel, np.array([0.0, 60, 60, 60]), np.array([0.0, 480, 660, 0]), np.array([1440.0, 600, 1440, 1440]))
    sets, _ = op.day_sets(day)
    assert 0b011 not in sets and 0b111 in sets


def test_large_trips_state_a_gap():
    day, value, kind = instance(3, 24)
    best, bound, routes = op.best_plan(day, 2, value, kind)
    assert best <= bound and sum(map(len, routes)) <= 12


def test_ten_stops_are_quick():
    day, value, kind = instance(5, 10)
    op.best_plan(day, 2, value, kind)
    t = time.process_time()
    for seed in range(5):
        op.best_plan(*((d, 2, v, k) for d, v, k in [instance(seed, 10)]).__next__())
    assert (time.process_time() - t) / 5 < 0.5


def test_rows(spark):
    from lumbria.plans.trips import _stops

    stops = _stops(spark, "/root/testdata/sf0.001").where("trip < 3")
    got = {r.trip: r for r in op.exact_plans(stops).collect()}
    plans = {r.trip: r.n for r in tr.day_plans(stops).groupBy("trip").count().withColumnRenamed("count", "n").collect()}
    assert set(got) == {0, 1, 2} and all(r.best == r.bound and len(r.routes) == 1 + t % 3 for t, r in got.items()) and set(plans) <= set(got)
    g = stops.where("trip = 1").toPandas()
    names, day, value, kind = tr._arrays(g, 480, 600)
    route = tr.plan([day] * 2, value, kind)
    assert got[1].best >= worth([s for r in route for s in r], value, kind) - 1e-9


def test_day_without_hours_and_large_trips(spark):
    from lumbria.plans.trips import _stops

    stops = _stops(spark, "/root/testdata/sf0.001")
    one = stops.where("trip = 2 AND stop < 26")
    g = one.toPandas()
    _, d, value, _ = tr._arrays(g, 0, 600)
    want = 0.0
    for size in range(1, 7):
        for o in permutations(range(1, len(value)), size):
            cost = sum(d.travel[a, b] for a, b in zip((0, *o), (*o, 0), strict=True)) + d.visit[list(o)].sum()
            if cost <= 600:
                want = max(want, float(value[list(o)].sum()))
    assert [tuple(r) for r in tr.exact_day(one).collect()] == [(2, want)]
    many = stops.where("stop < 19").selectExpr("1L AS trip", "* EXCEPT (trip)")
    assert [tuple(r) for r in tr.exact_day(many).collect()] == [(1, None)]
