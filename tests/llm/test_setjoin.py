"""The Jaccard join against all pairs."""

import collections
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from lumbria.llm import setjoin
from lumbria.llm.textcols import ASCII_LOWER

from .cases import ROWS, docs, empty, prose

TOP = 2**63 - 1


def shingles(text, words=5):
    w = (text or "").encode().translate(ASCII_LOWER).split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def expected(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root(k)] = min(low.get(root(k), TOP), TOP if i is None else i)
    back = lambda i: None if i == TOP else i
    return collections.Counter((i, len(sets[k]), back(low[root(k)])) for k, (i, _) in enumerate(rows))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice("xyz") + str(r.randrange(99)) if r.random() < share else w for w in text.split())


def family(seed, n=40):
    """Copies at all degrees of likeness, short and long, around a passage that all share."""
    r = random.Random(seed)
    shared, rows = prose(60, 77), []
    for k in range(n):
        base = prose(r.choice([4, 5, 8, 9, 10, 12, 20, 30, 60, 200]), r.randrange(8))
        text = edited(base, r.choice([0, 0.01, 0.02, 0.04, 0.1]), r.random())
        if r.random() < 0.4:
            text = f"{text} {shared}"
        if r.random() < 0.2:
            text = f"{text} {prose(r.randint(1, 6), r.random())}"
        rows.append((1000 - k, text))
    return rows


FAMILY = family(3, 120)


def test_classes(spark):
    rows = [*ROWS, *FAMILY, (7, "one two"), (8, "ONE  two"), (9, "one"), (None, "one two")]
    got = setjoin.classes(docs(spark, rows).repartition(4))
    assert collections.Counter(map(tuple, got.collect())) == expected(rows)
    assert setjoin.classes(empty(spark)).count() == 0


@pytest.mark.parametrize("light", [0, 64])
def test_blocks_and_boundaries(spark, monkeypatch, light):
    """All groups dealt in blocks; all sets heavy, or all that may be light."""
    monkeypatch.setattr(setjoin, "boundary", lambda own, percent: light)
    got = setjoin.classes(docs(spark, FAMILY).repartition(4), block=700)
    assert collections.Counter(map(tuple, got.collect())) == expected(FAMILY)


def test_frequent_shingles_go_last(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "FREQUENT", 3)
    often = setjoin.frequent(docs(spark, FAMILY).select("doc_id", "text"))
    assert len(often) > 50 and (np.diff(often.astype(object)) > 0).all()
    got = setjoin.classes(docs(spark, FAMILY))
    assert collections.Counter(map(tuple, got.collect())) == expected(FAMILY)


def test_keys_of_linked_sets_meet():
    """Any two linked sets have a first shingle in common, and two of one more."""
    r = random.Random(5)
    for _ in range(3000):
        n = r.randint(2, 40)
        a = set(r.sample(range(10**6), n))
        b = set(r.sample(sorted(a), max(1, n - r.randint(0, 5)))) | {r.randrange(10**6) for _ in range(r.randint(0, 5))}
        both = len(a & b)
        if 100 * both >= 80 * len(a | b) and min(len(a), len(b)) > 1:
            first = lambda s, more: sorted(s)[: setjoin.apart(len(s), 80) + more]
            assert set(first(a, 1)) & set(first(b, 1))
            assert len(set(first(a, 2)) & set(first(b, 2))) >= 2 or a == b


def test_outline_bounds_what_sets_share():
    r = np.random.default_rng(1)
    for _ in range(200):
        top = r.choice([400, 2000, 20000])
        a = np.unique(r.integers(0, top, r.integers(1, top)).astype(np.uint64))
        b = np.unique(np.r_[a[r.random(len(a)) < 0.95], r.integers(0, top, r.integers(1, 9)).astype(np.uint64)])
        n = np.array([len(a), len(b)])
        loads = [setjoin.outline(x) + x.tobytes() for x in (a, b)]
        exact = 180 * len(np.intersect1d(a, b)) - 80 * n.sum()
        bound = setjoin.Outlines(n, [setjoin.outline(x) for x in (a, b)], 80).excess(0, np.array([1]))[0]
        assert bound >= exact
        if bound >= 0:
            assert setjoin.Wholes(n, loads, 80).excess(0, np.array([1]))[0] == exact


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op11_heavy_light"](spark, small).collect()
    assert collections.Counter(map(tuple, got)) == expected(rows)
