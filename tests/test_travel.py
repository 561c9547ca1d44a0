import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbria.functions import parsers
from lumbria.operators import joins, reports, search, sky, zones


def km(a, b, c, d):
    x, y = math.radians(a), math.radians(c)
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


ALTITUDES = {
    "412": (412, 412), "1,205 m": (1205, 1205), "2980 m.s.n.m.": (2980, 2980), "4.010 msnm": (4010, 4010), "2 075 msnm": (2075, 2075), "80 - 940": (80, 940), "3905 a 4120": (3905, 4120),
    "99120034": None, "por definir": None, "4, 205": (4205, 4205), "5 y 6 y 7": None, "512,4": (512.4, 512.4), "3,871.05": (3871.05, 3871.05), None: None, "900 hasta 700": (700, 900), "310 405": None, "7.25": (7.25, 7.25),
}
DAYS = {
    "De jueves a domingo": [3, 4, 5, 6], "Martes y sábados": [1, 5], "todos los días salvo miércoles": [0, 1, 3, 4, 5, 6], "domingo cerrado": [0, 1, 2, 3, 4, 5], "sábado a martes": [0, 1, 5, 6], "previa cita": None,
    "cerrado los jueves": [0, 1, 2, 4, 5, 6], "Martes - jueves": [1, 2, 3], "lunes a viernes, sábado: cerrado": [0, 1, 2, 3, 4], "No se atiende los lunes": [1, 2, 3, 4, 5, 6], "diario": list(range(7)), "": None, None: None, "miercoles no abre": [0, 1, 3, 4, 5, 6],
}


@pytest.mark.parametrize(("texts", "parse"), [(ALTITUDES, parsers.altitude), (DAYS, parsers.open_days)])
def test_parsers(spark, texts, parse):
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", parse(F.col("t")).alias("v")).collect():
        want = texts[r.t]
        assert (r.v if parse is parsers.open_days else tuple(r.v)) == (want if parse is parsers.open_days else want or (None, None)), r.t


@pytest.mark.parametrize("reach", [30, 900, 3000])
def test_radius_join_loses_no_pair_at_any_latitude(spark, reach):
    r = random.Random(reach)
    points = [(k, math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for k in range(120)]
    points += [(120 + k, r.choice((-89.9, 89.95, 88.0, -75.0)), r.uniform(-180, 180)) for k in range(60)] + [(180, 10.0, 179.99), (181, 10.0, -179.99), (182, 90.0, 0.0), (183, None, 1.0)]
    d = spark.createDataFrame(points, "id long, lat double, lon double")
    got = {(x.id, x.r_id) for x in joins.radius_join(d, d.withColumnRenamed("id", "r_id"), reach).select("id", "r_id").collect()}
    want = {(a[0], b[0]) for a, b in itertools.product(points[:-1], repeat=2) if km(*a[1:], *b[1:]) <= reach}
    assert got == want
    near = {(x.id, x.place): x.r_id for x in joins.nearest(d, d.withColumnRenamed("id", "r_id"), ["id"], ["r_id"], reach, 2).collect()}
    for p in points[:-1]:
        best = sorted((km(*p[1:], *q[1:]), q[0]) for q in points[:-1] if km(*p[1:], *q[1:]) <= reach)[:2]
        assert [near.get((p[0], k + 1)) for k in range(len(best))] == [q for _, q in best]


def test_complete_linkage_and_first_kept(spark):
    r = random.Random(4)
    at = {k: (r.random() * 10, r.random() * 10) for k in range(60)}
    dist = lambda a, b: math.dist(at[a], at[b])
    groups = [{k} for k in at]
    while True:
        far, i, j = min((max(dist(a, b) for a in x for b in y), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2))
        if far > 4:
            break
        groups[i] |= groups.pop(j)
    want = {frozenset(g) for g in groups if len(g) >= 3}
    p = spark.createDataFrame([(1, k) for k in at], "block long, key long")
    e = spark.createDataFrame([(1, a, b, dist(a, b)) for a, b in itertools.combinations(at, 2) if dist(a, b) <= 4], "block long, a long, b long, d double")
    got = {}
    for x in zones.complete_linkage(p, e, 4.0, least=3).collect():
        got.setdefault(x.group, set()).add(x.key)
    got.pop(-1, None)
    assert {frozenset(g) for g in got.values()} == want
    assert [len(got[k]) for k in sorted(got)] == sorted((len(g) for g in want), reverse=True)

    rows = [(k, "ab"[k % 2], k * 7 % 11, r.uniform(0, 1), r.uniform(0, 1)) for k in range(80)]
    d = spark.createDataFrame(rows, "id long, same string, rank long, lat double, lon double")
    kept = []
    for x in sorted(rows, key=lambda x: (x[2], x[0])):
        if not any(y[1] == x[1] and km(*x[3:], *y[3:]) <= 20 for y in kept):
            kept.append(x)
    assert {x.id for x in zones.first_kept(d, "id", ["rank"], "same", 20.0).collect()} == {x[0] for x in kept}
    assert zones.first_kept(d.limit(0), "id", ["rank"], "same", 20.0).count() == 0


def test_judged_names_the_first_reason(spark):
    q = spark.createDataFrame([(1, "a", 1, 3, [], 100, 2000, True, False), (2, "a", 1, 1, [], 100, None, True, False), (3, "a", 1, 3, [], 100, None, False, True)], "query long, origin string, month int, days int, interests array<string>, budget int, max_altitude int, by_land boolean, surprise boolean")
    z = spark.createDataFrame([(1, 1, None, True), (2, 2, 3000, True), (3, 3, 100, False), (4, 4, 100, True), (5, 5, 100, True)], "zone long, base long, base_altitude int, off_circuit boolean")
    a = spark.createDataFrame([("a", 1, 100.0, None), ("a", 2, 100.0, None), ("a", 3, 10.0, None), ("a", 4, None, 90.0), ("a", 5, 800.0, None)], "origin string, zone long, land_minutes double, air_minutes double")
    s = spark.createDataFrame([(k, k, 1, [], 60, 50, False, 5.0) for k in range(1, 5)] + [(9, 5, 1, [], 400, 50, False, 5.0)], "stop long, zone long, rank int, interests array<string>, visit int, altitude int, night boolean, reach double")
    got = {(r["query"], r.zone): r.reason for r in search.judged(q, z, a, s).collect()}
    assert [got[1, k] for k in range(1, 6)] == ["altitude_unknown", "too_high", "at_home", "no_way", "too_short"]
    assert [got[2, k] for k in range(1, 6)] == [None, None, None, None, "no_stops"]
    assert got[3, 3] == "on_circuit" and got[3, 4] is None


def test_clear_nights_take_the_nearest_report_that_says(spark):
    rows = [(1, "2026-01-01 01:45:00", "x SCT020"), (1, "2026-01-01 02:05:00", "x FEW010"), (1, "2026-01-01 02:00:00", "nothing"), (1, "2026-01-01 06:31:00", "CAVOK"), (2, "2026-01-01 06:20:00", "FEW010 BKN100")]
    d = spark.createDataFrame(rows, "station int, at string, report string").withColumn("at", F.col("at").cast("timestamp"))
    assert {(r.station, r.hour, r.clear) for r in sky.clear_nights(d).collect()} == {(1, 2, True), (2, 6, False)}


def test_sun_and_moon(spark):
    """Almanac facts: the sun over the equator at an equinox's noon, new and full moons of 2026, the long polar night."""
    d = spark.createDataFrame([("2026-03-20 12:07:00", "2026-01-18 19:52:00", "2026-01-03 10:03:00")], "a string, new string, full string")
    r = d.select(sky.sun_altitude(F.col("a").cast("timestamp"), F.lit(0.0), F.lit(0.0)).alias("s"), sky.moon_light(F.col("new").cast("timestamp")).alias("n"), sky.moon_light(F.col("full").cast("timestamp")).alias("f")).first()
    assert r.s > 89 and r.n < 0.01 and r.f > 0.99
    n = spark.createDataFrame([(1, 89.0, 0.0), (2, -12.0, -77.0)], "id long, lat double, lon double").withColumn("night", F.lit("2026-06-21").cast("date"))
    dark = {x.id: x.dark_hours for x in sky.dark_hours(n).collect()}
    assert dark[1] == 0 and 0 <= dark[2] <= 12
    days = spark.range(365).select(F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    moons = [x.day.timetuple().tm_yday for x in sky.new_moons(days).orderBy("day").collect()]
    assert 12 <= len(moons) <= 13 and set(np.diff(moons).tolist()) <= {29, 30}


def test_reports_stand_empty_tables(spark):
    none = spark.createDataFrame([], "query long, zone long, origin long")
    r = reports.coverage(none, spark.range(3).withColumnRenamed("id", "query")).first()
    assert r.with_0 == 3 and r.trips is None
    assert reports.blind_kit(none.withColumn("system", F.lit("x")), "s").count() == 0


def test_best_order_and_day_plans(spark):
    from lumbria.operators import trips

    r = random.Random(6)
    rows = [(t, t * 10 + k, -12 + r.random() / 3, -77 + r.random() / 3, -12.0, -77.0, float(r.randrange(30, 90)), 420.0, 1200.0, r.random() * 10, "abc"[k % 3], 2) for t in range(4) for k in range(6)]
    d = spark.createDataFrame(rows, "trip long, stop long, lat double, lon double, base_lat double, base_lon double, visit double, opens double, closes double, value double, kind string, days int")
    got = {x.trip: (x.given, x.best) for x in trips.best_order(d).collect()}
    for t in range(4):
        at = [(-12.0, -77.0)] + [(x[2], x[3]) for x in rows if x[0] == t]
        tour = lambda o: sum(km(*at[a], *at[b]) for a, b in itertools.pairwise([0, *o, 0])) * 1.5  # noqa: E731, B023
        assert got[t] == pytest.approx((tour(range(1, 7)), min(map(tour, itertools.permutations(range(1, 7))))))
    plans = trips.day_plans(d).collect()
    assert len({(x.trip, x.stop) for x in plans}) == len(plans) > 8
    for t in range(4):
        for day in (1, 2):
            own = sorted((x for x in plans if x.trip == t and x.day == day), key=lambda x: x.place)
            assert [x.place for x in own] == list(range(1, len(own) + 1)) and len(own) <= 6
            assert all(420 <= x.arrives < y.arrives <= 1200 for x, y in itertools.pairwise(own))


def test_distances(spark):
    from lumbria.functions.distances import distance_time

    want = {
        "14 km / 1 h 10 min": (14, 70, False), "3 km 250 metros": (3.25, None, False), "4 dias de ida y cuatro dias de retorno": (None, 5760, False), "3h 25m": (None, 205, False), "120 m / 12 m": (0.12, 12, False), "48 K. 35 m.": (48, 35, False),
        "25:00 minutos": (None, 25, False), "60 km / 1:30 min": (60, 90, True), "95km / 2.20 min": (95, 140, True), "1.15 horas": (None, 75, True), "media hora": (None, 30, False), "tres horas y media": (None, 210, False), "5 horas 9 km": (9, 300, False),
        "1,450 m": (1.45, None, False), "2 millas": (3.704, None, False), "2 1/2 km": (2.5, None, False), "31": (None, None, False), None: (None, None, False), "un cuarto de hora": (None, 15, False),
    }
    d = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: tuple(r.v) for r in d.select("t", distance_time(F.col("t")).alias("v")).collect()} == want


def test_access_without_alternatives(spark):
    from lumbria.operators import rules

    r = random.Random(11)
    rows = [(code, way, seq, r.choice("ab"), r.choice("ab"), r.choice((1.0, 2.0, None)), r.choice((5.0, 7.0, 9.0, None)) if r.random() < 0.5 else 6.0, r.choice(("Vía A", "via-a", "", None)), r.choice(("A pie", "Auto"))) for code in range(60) for way in range(2) for seq in range(4)]
    d = spark.createDataFrame(rows, "code long, way long, seq long, start string, end string, km double, minutes double, detail string, means string")
    key = {"Vía A": "viaa", "via-a": "viaa"}
    want = {}
    for code in range(60):
        best = []
        for way in range(2):
            kept = []
            for x in (x for x in rows if x[:2] == (code, way)):
                for i, e in enumerate(kept):
                    if e[3:5] == x[3:5] and (e[5] == x[5] or (key.get(e[7]) and key.get(e[7]) == key.get(x[7]))):
                        if x[6] is not None and (e[6] is None or x[6] < e[6]):
                            kept[i] = x
                        break
                else:
                    kept.append(x)
            whole = all(x[6] is not None for x in kept)
            walk = 0.0
            for x in reversed(kept):
                if x[8] != "A pie" or x[6] is None:
                    break
                walk += x[6]
            km_all = sum(x[5] for x in kept) if all(x[5] is not None for x in kept) else None
            best.append((not whole, sum(x[6] for x in kept) if whole else 0.0, way, km_all, walk if whole else None, kept[-1][8]))
        b = min(best)
        want[code] = (b[3], None if b[0] else b[1], b[4], b[5], 2)
    assert {x.code: (x.km, x.minutes, x.walk, x.last_means, x.ways) for x in rules.access_summary(d).collect()} == want


def test_nightly_places(spark):
    from lumbria.operators import rules

    r = random.Random(12)
    places = [(z, z * 100 + k, r.choice("abc"), r.randrange(1000) * 10 + k) for z in range(8) for k in range(z)]
    nights = [(z, z % 5) for z in range(8)]
    want = set()
    for z, n in nights:
        own = sorted((p for p in places if p[0] == z), key=lambda p: -p[3])
        left = list(range(len(own)))
        for night in range(n if own else 0):
            if len(left) < min(3, len(own)):
                left = list(range(len(own)))
            picked = []
            for i in left:
                if len(picked) < 3 and own[i][2] not in {own[j][2] for j in picked}:
                    picked.append(i)
            picked += [i for i in left if i not in picked][: 3 - len(picked)]
            left = [i for i in left if i not in picked]
            want |= {(z, night + 1, own[i][1]) for i in picked}
    got = rules.nightly(spark.createDataFrame(places, "zone long, place long, kind string, trust long"), spark.createDataFrame(nights, "zone long, nights int")).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_prose_dates(spark):
    from lumbria.functions.dates import prose_rule

    want = {
        "La fiesta es el 3 de mayo": ("fija 05-03", "day"), "del 12 al 15 de julio": ("fija 07-12..07-15", "range"), "30 de diciembre al 2 de enero": ("fija 12-30..01-02", "range_months"), "tercer sábado de noviembre": ("nesimo 11 3 sab", "weekday"),
        "segunda semana de abril": ("fija 04-08..04-14", "part"), "de mayo a julio": ("mes 05..07", "months"), "Agosto": ("mes 08", "month"), "todo el año": (None, None), "": (None, None), None: (None, None), "1ro de setiembre": ("fija 09-01", "day"),
    }
    d = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: tuple(r.v) for r in d.select("t", prose_rule(F.col("t")).alias("v")).collect()} == want


def test_assigned_zones_follow_the_order(spark):
    r = random.Random(13)
    members = [(b, b * 10 + k % 3, -12 + r.random(), -77 + r.random(), float(r.randrange(0, 500))) for b in range(3) for k in range(6)]
    pending = [(b, b * 100 + k, k % 4, -12 + r.random(), -77 + r.random(), r.choice((None, float(r.randrange(0, 500)))), bool(k % 2)) for b in range(3) for k in range(20)]
    want = {}
    for b in range(3):
        zone = {}
        for x in members:
            if x[0] == b:
                zone.setdefault(x[1], []).append(x[2:])
        for x in sorted((x for x in pending if x[0] == b), key=lambda x: (x[2], x[1])):
            far = lambda z: max(math.hypot(km(*x[3:5], *y[:2]), 0.06 * abs((y[2] or 0) - (x[5] or 0))) for y in zone[z])  # noqa: E731, B023
            best = min(sorted(zone), key=far)
            want[x[1]] = best if far(best) <= 80 else None
            if want[x[1]] is not None and x[6]:
                zone[best].append(x[3:6])
    m = spark.createDataFrame(members, "block long, zone long, lat double, lon double, alt double")
    p = spark.createDataFrame(pending, "block long, id long, place int, lat double, lon double, alt double, counts boolean")
    assert {x.id: x.zone for x in zones.assigned(m, p).collect()} == want


def test_paths_sum_up_along_and_retry(spark):
    from lumbria.operators import network

    e = spark.createDataFrame([(1, 2, 5.0, 0.0, True), (2, 3, 5.0, 7.0, True), (1, 3, 20.0, 1.0, True), (3, 4, 1.0, 2.0, False), (5, 6, 1.0, 1.0, True)], "u long, v long, cost double, train double, inside boolean")
    got = {(r.source, r.node): (r.cost, r.train) for r in network.shortest_paths(e, spark.createDataFrame([(1, 1)], "source long, node long"), along=("train",)).collect()}
    assert got == {(1, 1): (0, 0), (1, 2): (5, 0), (1, 3): (10, 7), (1, 4): (11, 9)}
    pairs = spark.createDataFrame([(1, 3), (1, 4), (1, 6)], "source long, node long")
    got = {(r.source, r.node): (r.cost, r.train) for r in network.paths_with_retry(e, pairs, "inside", ("train",)).collect()}
    assert got == {(1, 3): (10, 7), (1, 4): (11, 9), (1, 6): (None, None)}
