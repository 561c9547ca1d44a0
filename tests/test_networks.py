"""Town patches against a flood fill, calibration against planted paces."""

import random

import pytest

from lumbria.operators import patches, rerouting


def filled(cells):
    """Each cell with the first one of its patch, by flood fill."""
    left, out = set(cells), {}
    while left:
        todo, own = [min(left)], []
        left.discard(todo[0])
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for c in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if c in left:
                    left.discard(c)
                    todo.append(c)
        out |= dict.fromkeys(own, min(own))
    return out


@pytest.mark.parametrize("tile", [1, 3, 256])
def test_patches(spark, tile):
    r = random.Random(8)
    cells = {(r.randint(-9, 9), r.randint(-9, 9)) for _ in range(130)} | {(k, 30) for k in range(-20, 20)} | {(50, 50)}
    got = patches.patches(spark.createDataFrame([*cells, (50, 50), (None, 1)], "y long, x long"), tile).collect()
    assert {(r.y, r.x): (r.py, r.px) for r in got} == filled(cells) and len(got) == len(cells)
    assert patches.patches(spark.createDataFrame([], "y long, x long"), tile).count() == 0


def test_bands_of_towns(spark):
    """A grid of streets every 100 m, 3 km wide, and a road out of it."""
    n = 31
    at = lambda k: (-12 + k // n * 0.0009, -77 + k % n * 0.0009)
    nodes = [(k, *at(k)) for k in range(n * n)] + [(5000 + k, -11.9 + k * 0.05, -77.0) for k in range(5)] + [(9000, None, None)]
    edges = [(k, k + 1) for k in range(n * n) if k % n < n - 1] + [(k, k + n) for k in range(n * n - n)] + [(0, 5000)] + [(5000 + k, 5001 + k) for k in range(4)]
    edges += [(b, a) for a, b in edges] + [(7, 7)]
    got = {r.node: r for r in patches.town_bands(spark.createDataFrame(nodes, "node long, lat double, lon double"), spark.createDataFrame(edges, "u long, v long"), bands=(1.0, 5.0, 500.0)).collect()}
    assert len(got) == len(nodes)
    assert got[15 * n + 15].band == 2 and 5 < got[15 * n + 15].km2 < 16
    assert all(got[5000 + k].band == 0 and got[5000 + k].py is None for k in range(5)) and got[9000].km2 == 0


def grid(side, fast=lambda y: y % 4 == 0):
    """Streets both ways, each 1 to 2 km, fast ones along some rows."""
    out = []
    for y in range(side):
        for x in range(side):
            k = y * side + x
            for v, f in ([(k + 1, fast(y))] if x + 1 < side else []) + ([(k + side, False)] if y + 1 < side else []):
                km = 1 + (k * 37 + v) % 11 / 10
                out += [(a, b, km, "trunk" if f else "street", 1, f) for a, b in ((k, v), (v, k))]
    return out


KIND = "u long, v long, km double, kind string, band int, fast boolean"


def test_planted_paces_come_back(spark):
    side, true = 9, {"trunk": 1.0, "street": 1.75}
    e = spark.createDataFrame(grid(side), KIND)
    cells = spark.createDataFrame([(k, str(k // side // 3)) for k in range(side * side)], "node long, c0 string")
    r = random.Random(2)
    pairs = spark.createDataFrame([(r.randrange(side**2), r.randrange(side**2)) for _ in range(60)] + [(0, 4711)], "source long, node long").distinct()
    trips = rerouting.composed(e, cells, pairs, true).select("source", "node", "routed").collect()
    timed = spark.createDataFrame([(t.source, t.node, t.routed and t.routed * r.uniform(0.999, 1.001)) for t in trips], "source long, node long, minutes double")
    paces, out, settled = rerouting.calibrated(e, cells, timed, {"trunk": 2.0, "street": 2.0}, scale=0.5, tolerance=1e-3)
    assert settled and all(abs(paces[k] / v - 1) < 0.01 for k, v in true.items())
    rows = out.withColumn("p", rerouting.predicted(out, paces)).where("routed IS NOT NULL").collect()
    assert rows and all(abs(x.p - x.routed) < 1e-9 * (1 + x.routed) for x in rows)


def test_floors_reach_what_was_measured(spark):
    side = 9
    e = spark.createDataFrame(grid(side), KIND)
    cells = spark.createDataFrame([(k, str(k // side // 3)) for k in range(side * side)], "node long, c0 string")
    r = random.Random(4)
    pairs = spark.createDataFrame([("t", a, b) for a, b in {(r.randrange(side**2), r.randrange(side**2)) for _ in range(60)}], "town string, source long, node long")
    towns = {"t": (1, 60.0, 30.0)}
    floors = rerouting.town_floors(e, cells, towns, pairs, {"trunk": 0.5, "street": 1.0}, km=(6.0, 14.0), tolerance=0.05, rounds=6)
    got = rerouting.town_paces(e, cells, pairs, {"trunk": 0.5, "street": 1.0}, floors, (6.0, 14.0)).first()
    assert floors[1, True] == 1.0 and got.pairs > 10 and abs(got.min_10km / 30 - 1) <= 0.05
    whole = rerouting.composed(e, cells, pairs.select("source", "node"), {"trunk": 0.5, "street": 1.0}, floors)
    assert whole.where("town_minutes > 0 AND km_all > 0").count() > 10
    with pytest.raises(ValueError, match="has a way"):
        rerouting.town_floors(e, cells, {"u": (1, 60.0, 30.0)}, pairs, {"trunk": 0.5, "street": 1.0})
