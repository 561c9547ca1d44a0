"""Density clusters against a version that takes the whole graph apart, edge weight by edge weight."""

import random

import pytest

from lumbria.functions.geo import RADIUS_KM
from lumbria.operators import density


def apart(p, q):
    import math

    a, b, c, d = (math.radians(x) for x in (*p, *q))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * RADIUS_KM * math.asin(min(1.0, math.sqrt(h)))


def graph(at, km, k):
    d = {(i, j): apart(at[i], at[j]) for i in at for j in at if i != j}
    core = {i: sorted(d[i, j] for j in at if j != i)[k - 2] for i in at}
    return {(i, j): max(d[i, j], core[i], core[j]) for i in at for j in at if i < j and d[i, j] <= km and core[i] <= km and core[j] <= km}


def parts(ids, w, most):
    """Connected parts of ids over pairs of less than most."""
    left, out = set(ids), []
    while left:
        todo, own = [left.pop()], []
        while todo:
            x = todo.pop()
            own.append(x)
            near = {y for y in left if w.get((min(x, y), max(x, y)), 1e9) < most}
            left -= near
            todo += near
        out.append(sorted(own))
    return out


def split(ids, w, born, least):
    """(worth, clusters) of a cluster that arises at 1 / born."""
    own = {p: x for p, x in w.items() if p[0] in ids and p[1] in ids}
    stays, here = 0.0, sorted(ids)
    for weight in sorted(set(own.values()), reverse=True):
        now = [p for p in parts(here, own, weight)]
        if len(now) == 1:
            continue
        big = [p for p in now if len(p) >= least]
        if len(big) == 1:
            stays += (len(here) - len(big[0])) * (1 / weight - 1 / born)
            here = big[0]
            continue
        stays += len(here) * (1 / weight - 1 / born)
        inner = [split(set(p), own, weight, least) for p in big]
        below = sum(x for x, _ in inner)
        return (stays, [sorted(ids)]) if stays >= below else (below, [c for _, cs in inner for c in cs])
    return stays, [sorted(ids)]


def expected(at, km, k, least):
    w = graph(at, km, k)
    out = dict.fromkeys(at)
    for p in parts({x for pair in w for x in pair}, w, 1e8):
        if len(p) >= least:
            for c in split(set(p), w, km, least)[1]:
                out |= dict.fromkeys(c, min(c))
    return out


def places(seed, n):
    r = random.Random(seed)
    spots = [(r.uniform(-12.3, -11.7), r.uniform(-77.3, -76.7), r.choice([0.005, 0.02, 0.05])) for _ in range(5)]
    rows = {}
    for k in range(n):
        a, b, s = r.choice(spots)
        rows[1000 - k] = (r.gauss(a, s), r.gauss(b, s)) if r.random() < 0.8 else (r.uniform(-12.5, -11.5), r.uniform(-77.5, -76.5))
    return rows


@pytest.mark.parametrize(("seed", "n", "km", "k", "least"), [(1, 120, 30.0, 4, 5), (2, 120, 12.0, 3, 4), (3, 90, 200.0, 5, 8)])
def test_clusters(spark, seed, n, km, k, least):
    at = places(seed, n)
    df = spark.createDataFrame([(i, *p) for i, p in at.items()] + [(5000, None, None)], "id long, lat double, lon double")
    got = {r.id: r.cluster for r in density.density_clusters(df, km, k, least).collect()}
    assert got == expected(at, km, k, least) | {5000: None}
    assert len({c for c in got.values() if c}) >= 2


def test_forest_is_least(spark):
    at = places(7, 80)
    w = graph(at, 40.0, 4)
    up = {i: i for i in at}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    want = set()
    for (a, b), x in sorted(w.items(), key=lambda e: (e[1], e[0])):
        if root(a) != root(b):
            up[root(a)] = root(b)
            want.add((a, b))
    edges = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "a long, b long, w double")
    assert {(r.a, r.b) for r in density.spanning_forest(edges).collect()} == want


def test_nothing_near(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "id long, lat double, lon double")
    assert {tuple(r) for r in density.density_clusters(df, 5.0).collect()} == {(1, None), (2, None)}
