"""Periodic runs against a search that tries every period."""

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from lumbria.llm import periodic

from .cases import ROWS, docs, empty, prose


def least_period(w):
    """By the failure function."""
    fail = [0] * len(w)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def runs_expected(w, least=24, times=3):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q) and least_period(w[i : j + q]) == q:
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def row_expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = runs_expected(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def loops(seed, n, letters):
    """Words with stretches that repeat, some with a fault, some within others."""
    r, out = random.Random(seed), []
    while len(out) < n:
        part = [r.randrange(letters) for _ in range(r.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 40, 100]))]
        if r.random() < 0.3:
            part = part * r.randint(2, 9) + [r.randrange(letters)]
        out += part * r.randint(1, 6)
        if r.random() < 0.3:
            out[r.randrange(len(out))] = r.randrange(letters)
        if r.random() < 0.5:
            out += part[: r.randint(0, len(part))]
    return out[:n]


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_finder(seed, letters):
    w = loops(seed, random.Random(seed).choice([0, 5, 23, 24, 25, 100, 400, 900]), letters)
    assert periodic.Finder(np.array(w, np.int64)).runs() == runs_expected(w)


@pytest.mark.parametrize(("least", "times"), [(1, 3), (7, 3), (40, 4)])
def test_other_bounds(least, times):
    for seed in range(20):
        w = loops(seed, 200, 3)
        assert periodic.Finder(np.array(w, np.int64), least, times).runs() == runs_expected(w, least, times)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120))
def test_any_words(w):
    assert periodic.Finder(np.array(w, np.int64)).runs() == runs_expected(w)


def test_segments(monkeypatch):
    monkeypatch.setattr(periodic, "SEGMENT", 32)
    monkeypatch.setattr(periodic, "KEY", 4)
    for seed in range(25):
        w = loops(seed, 500, 4)
        assert periodic.Finder(np.array(w, np.int64)).runs() == runs_expected(w)


def test_long_text():
    w = [0] * 300_000
    assert periodic.Finder(np.array(w)).runs() == [(0, 300_000, 1)]
    part = list(range(70_000))
    assert periodic.Finder(np.array([1, *part, *part, *part, 2])).runs() == [(1, 210_000, 70_000)]


def test_rows(spark):
    rows = [*ROWS, (40, "la " * 100), (41, (prose(30, 9) + " ") * 5), (42, "a\u00a0b " * 30 + "x\ty\x0bz"), (43, (prose(3, 1) + "\n") * 8)]
    got = entry_rows(periodic.periodic_runs(docs(spark, rows)))
    want = collections.Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        runs = runs_expected(w)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        want[i, tuple(runs), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    assert got == want
    assert periodic.periodic_runs(empty(spark)).count() == 0


def entry_rows(df):
    return collections.Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in df.collect())


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = entry.queries()["op12_block_runs"](spark, small)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(row_expected(*r) for r in rows)
