"""Comparison of any number of rows, and clustering over sparse pairs, against plain versions."""

import random

import numpy as np
import pytest

from lumbria.operators import evaluation as ev
from lumbria.operators import zones


def test_signed_ranks(spark):
    r = random.Random(3)
    d = [r.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2, 4]) + 0.0 for _ in range(300)]
    got = ev.signed_ranks(spark.createDataFrame([(x,) for x in d] + [(None,)], "d double").repartition(5), "d").first()
    old = ev.compared(spark.createDataFrame([(x, 0.0) for x in d], "a double, b double"), "a", "b", times=50).first()
    nz = sorted(abs(x) for x in d if x)
    rank = lambda x: (sum(y < x for y in nz) + sum(y <= x for y in nz) + 1) / 2
    assert (got.n, got.wins, got.losses, got.ties) == (300, old.wins, old.losses, old.ties)
    assert got.w_plus == pytest.approx(sum(rank(x) for x in d if x > 0)) and got.mean == pytest.approx(old.mean)
    import math

    assert math.erfc(abs(got.z) / math.sqrt(2)) == pytest.approx(old.wilcoxon_p)
    none = ev.signed_ranks(spark.createDataFrame([], "d double"), "d").first()
    assert none.n == 0 and none.w_plus == 0 and none.z is None and none["mean"] is None


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(5)
    d = rng.normal(0.3, 1.0, 4000)
    rows = spark.createDataFrame([(k, float(x)) for k, x in enumerate(d)] + [(9999, None)], "k long, d double")
    got = ev.bootstrap_interval(rows.repartition(3), ["k"], "d", times=800).first()
    half = 1.96 * d.std() / np.sqrt(len(d))
    assert got.low == pytest.approx(d.mean() - half, abs=0.15 * half) and got.high == pytest.approx(d.mean() + half, abs=0.15 * half)
    again = ev.bootstrap_interval(rows.repartition(7), ["k"], "d", times=800).first()
    assert again.low == pytest.approx(got.low, abs=1e-12)
    assert tuple(ev.bootstrap_interval(rows.limit(0), ["k"], "d", times=20).first()) == (None, None)


def merged(keys, pairs, limit, least):
    """Complete linkage over the full matrix."""
    groups = [[k] for k in keys]
    far = lambda a, b: max(pairs.get((min(x, y), max(x, y)), np.inf) for x in a for y in b)
    while True:
        best = min(((far(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), default=(np.inf,))
        if best[0] > limit:
            break
        _, i, j = best
        groups[i] = sorted(groups[i] + groups[j])
        del groups[j]
        groups.sort()
    kept = sorted((g for g in groups if len(g) >= least), key=lambda g: (-len(g), g[0]))
    return {k: n for n, g in enumerate(kept) for k in g}


@pytest.mark.parametrize("seed", range(4))
def test_complete_linkage_over_sparse_pairs(spark, seed):
    r = random.Random(seed)
    at = [(r.uniform(0, 9), r.uniform(0, 9)) for _ in range(45)]
    d = {(i, j): ((at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2) ** 0.5 for i in range(45) for j in range(i + 1, 45)}
    near = {p: x for p, x in d.items() if x <= 3.0}
    got = zones.complete_linkage(spark.createDataFrame([(1, k) for k in range(45)], "block long, key long"), spark.createDataFrame([(1, i, j, x) for (i, j), x in near.items()], "block long, a long, b long, d double"), 3.0, least=2)
    want = merged(range(45), near, 3.0, 2)
    assert {x.key: x.group for x in got.collect()} == {k: want.get(k, -1) for k in range(45)}


def test_a_block_of_many_points(spark):
    """A chain of 20,000 points, each near its neighbours alone."""
    n = 20_000
    got = zones.complete_linkage(spark.range(n).selectExpr("1L AS block", "id AS key"), spark.range(n - 1).selectExpr("1L AS block", "id AS a", "id + 1 AS b", "1.0D AS d"), 1.5, least=2)
    sizes = got.where("group >= 0").groupBy("group").count().groupBy("count").count().collect()
    assert [tuple(x) for x in sizes] == [(2, n // 2)]
