"""Timetables against a walk through each route, with pace by the hour, and typed cases of lunch."""

import random

import numpy as np
from pyspark.sql import functions as F

from lumbria.operators import timetable

STOP = "struct<stop:long,leg:double,visit:int,opens:int,closes:int,minor:boolean,weekdays:array<int>,food:boolean>"
SCHEMA = f"route long, start int, cap int, weekday int, food boolean, back double, stops array<{STOP}>, plan_note string"
PACE = [(360, 0.8), (480, 1.2), (780, 1.0), (1140, 1.35)]


def walked(start, cap, weekday, food, back, stops, pace):
    """(leaves, returns, minutes, lunch, visits) or None."""
    f = lambda t: float(np.interp(t % 1440, *zip(*pace, strict=True), period=1440)) if pace else 1.0
    if not stops:
        return start, start, 0, None, []
    if any(s[1] is None for s in stops) or back is None:
        return None
    t = leaves = max(start, stops[0][3] - round(stops[0][1]))
    lunch, used, visits, keep = None, 0, [], False
    if t >= 750 or (t >= 690 and t + stops[0][1] * f(t) > 840):
        m = max(start, 750 if t >= 750 else 690)
        lunch = (0, m if m + 60 <= t else t, None, False)
        t = leaves = leaves if m + 60 <= t else t + 60
    for k, (name, leg, visit, opens, closes, minor, days, eats) in enumerate(stops):
        way = leg * f(t)
        if way > 90 and (minor or (k and stops[k - 1][5])) or (days is not None and weekday is not None and weekday not in days):
            return None
        t += round(way)
        first_eat = max(t + 60, opens) + visit <= closes
        if not lunch and (keep or t > 840 or (t >= 690 and (opens - t >= 60 or (max(t, opens) + visit > 840 and first_eat)))):
            lunch, used, t = (k, t, name, True), 60, t + 60
        if opens - t > 60 or max(t, opens) + visit > closes:
            return None
        visits.append((name, t, round(way), max(0, opens - t)))
        t, keep = max(t, opens) + visit, False
        if not lunch and t >= 690:
            home = k + 1 == len(stops)
            _, leg2, v2, o2, c2, _, _, e2 = (0, back, 0, 0, 10**6, 0, 0, food) if home else stops[k + 1]
            n = t + round(leg2 * f(t))
            could = max(n + 60, o2) + v2 <= c2
            late = n > 840 or (max(n, o2) + v2 > 840 and not could)
            if late or (t >= 750 and (eats or not e2)):
                lunch, used, t = (k + 1, t, name, True), 60, t + 60
            else:
                keep = t >= 750 and could and not home
    way = back * f(t)
    if way > 90 and stops[-1][5]:
        return None
    returns = t + round(way)
    if not lunch and returns >= 750:
        lunch = (len(stops), returns, None, False)
    minutes = returns - leaves - used
    return (leaves, returns, minutes, lunch, visits) if minutes <= cap and returns <= start + cap + 60 else None


def plans(spark, rows, pace=()):
    got = timetable.timetables(spark.createDataFrame(rows, SCHEMA), pace=pace).collect()
    assert len(got) == len(rows)
    return {r.route: r.plan and (r.plan.leaves, r.plan.returns, r.plan.minutes, r.plan.lunch and tuple(r.plan.lunch), [tuple(v) for v in r.plan.visits]) for r in got}


def drawn(n, seed):
    r, rows = random.Random(seed), []
    for k in range(n):
        stops = []
        for i in range(r.randrange(1, 6)):
            opens = r.choice([0, 420, 540, 600, 690, 780])
            leg = None if r.random() < 0.02 else r.choice([5.0, 17.5, 42.5, 61.0, 93.0, 140.25])
            stops.append((i, leg, r.choice([15, 45, 90, 150]), opens, opens + r.choice([240, 480, 900]), r.random() < 0.15, r.choice([None, None, None, [0, 2, 4, 6]]), r.random() < 0.5))
        rows.append((k, r.choice([420, 480, 600, 700, 760]), r.choice([300, 480, 600, 720]), r.choice([None, 1, 2]), r.random() < 0.5, None if r.random() < 0.02 else r.choice([10.0, 75.5, 120.0]), stops, "x"))
    return rows


def test_against_a_walk(spark):
    for pace in ((), PACE):
        rows = drawn(1500, len(pace))
        want = {x[0]: walked(*x[1:7], pace) for x in rows}
        assert plans(spark, rows, pace) == want
        made = [w for w in want.values() if w]
        places = {(w[3][3], w[3][2] is None, w[3][0] == 0) for w in made if w[3]}
        assert len(made) > 150 and len(places) >= 4 and None in {w[3] for w in made}


def test_lunch_and_doors(spark):
    open_all = (0, 1440, False, None)
    rows = [
        (1, 480, 600, None, True, 20.0, [(7, 30.0, 60, 600, 1200, False, None, True)], None),  # leaves later than at eight
        (2, 480, 600, 1, True, 20.0, [(7, 30.0, 60, 0, 1200, False, [0, 2], True)], None),  # shut on that weekday
        (3, 480, 600, None, False, 20.0, [(7, 30.0, 250, *open_all, True)], None),  # eats where the visit ends
        (4, 480, 600, None, True, 20.0, [(7, 30.0, 250, *open_all, False)], None),  # the base has food: at home
        (5, 480, 600, None, False, 30.0, [(7, 30.0, 245, *open_all, False), (8, 20.0, 60, *open_all, True)], None),  # eats on arrival
        (6, 480, 600, None, False, 95.0, [(7, 30.0, 60, 0, 1440, True, None, True)], None),  # too far from a minor stop
        (7, 480, 600, None, False, 20.0, [(7, 30.0, 60, 0, 1440, False, None, True), (8, 10.0, 60, 700, 1440, False, None, True)], None),  # over an hour at a door
        (8, 480, 600, None, None, None, [], None),
        (9, 480, 600, None, None, 5.0, None, None),
    ]
    got = plans(spark, rows)
    assert got[1] == (570, 680, 110, None, [(7, 600, 30, 0)]) and got[2] is None and got[6] is None and got[7] is None
    assert got[3] == (480, 840, 300, (1, 760, 7, True), [(7, 510, 30, 0)]) and got[4] == (480, 780, 300, (1, 780, None, False), [(7, 510, 30, 0)])
    assert got[5][3] == (1, 775, 8, True) and got[5][4] == [(7, 510, 30, 0), (8, 835, 20, 0)]
    assert got[8] == got[9] == (480, 480, 0, None, [])


def test_no_rows_and_a_plan_in_the_engine(spark):
    empty = timetable.timetables(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and "plan_note" in empty.columns
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_pace(spark):
    minutes = [0, 100, 359, 360, 420, 480, 1000, 1140, 1300, 1439, 1500]
    got = [r.f for r in spark.createDataFrame([(m,) for m in minutes], "m int").select(timetable.pace_at(F.col("m"), PACE).alias("f")).collect()]
    assert np.allclose(got, np.interp(np.array(minutes) % 1440, *zip(*PACE, strict=True), period=1440))
