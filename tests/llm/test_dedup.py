import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbria.llm import exact_dedup, line_dedup, simhash, suffix_dedup

from .cases import ROWS, docs, empty, ids, prose

LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BIG = 2**63 - 1


def raw(rows=ROWS):
    return [(i if i is not None else BIG, (t or "").encode()) for i, t in rows]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_content_sort(spark, keep):
    groups = collections.defaultdict(list)
    for i, t in raw():
        groups[t.translate(LOW)].append(i)
    got = exact_dedup.groups(docs(spark), keep=keep).collect()
    assert len(got) == len(ROWS)
    for r in got:
        i = BIG if r.doc_id is None else r.doc_id
        own = next((k, g) for k, g in groups.items() if i in g and hashlib.sha256(k).hexdigest() == r.text_sha256)
        best = min(own[1]) if keep == "min" else max(own[1])
        assert (BIG if r.keep_id is None else r.keep_id, r.group_size) == (best, len(own[1]))
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups)  # of rows that repeat id and text, one
    assert exact_dedup.groups(empty(spark)).count() == 0


def test_content_sort_joins_runs_across_ranges(spark):
    rows = [(i, "One hot TEXT" if i % 3 else f"text {i}") for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.groups(docs(spark, rows), keep="max").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 3} == {(599, 400)}
    assert sum(r.kept for r in got) == 201


def lines_expected(rows):
    holders = collections.defaultdict(set)
    strip = b"\x20\x09\x0a\x0b\x0c\x0d"
    key = lambda x: x.strip(strip).translate(LOW)
    for i, t in rows:
        for x in t.split(b"\n"):
            if len(key(x).decode()) >= 10:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        ls = t.split(b"\n")
        left = [x for x in ls if not (len(key(x).decode()) >= 10 and len(holders[key(x)]) >= 2 and min(holders[key(x)]) != i)]
        out.append((i, len(ls), len(ls) - len(left), b"\n".join(left)))
    return sorted(out)


def kept_lines(store, d):
    return sorted((BIG if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text.encode()) for r in store.kept(d).collect())


def test_line_store_is_reversible(spark):
    rows, d = raw(), docs(spark)
    store = line_dedup.LineStore.of(d, keys_per_shard=4)
    assert store.state.where("filter IS NOT NULL").count() > 1
    assert kept_lines(store, d) == lines_expected(rows)
    more = [(0, ROWS[0][1]), (40, "and a second line of it\na line of its own, brand new")]
    grown = store.insert(docs(spark, more))
    assert kept_lines(grown, docs(spark, ROWS + more)) == lines_expected(raw(ROWS + more))
    assert sorted(map(tuple, grown.insert(docs(spark, more)).counts().collect())) == sorted(map(tuple, grown.counts().collect()))
    back = grown.delete(spark.createDataFrame([(0,), (40,)], "doc_id long"))
    assert sorted(map(tuple, back.counts().collect())) == sorted(map(tuple, store.counts().collect()))
    left = [r for r in ROWS if r[0] != 1]
    cut = store.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert kept_lines(cut, docs(spark, left)) == lines_expected(raw(left))
    assert kept_lines(line_dedup.LineStore.of(empty(spark)), empty(spark)) == []


def test_cuckoo_filter():
    h = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    f = line_dedup.CuckooFilter(5000)
    assert f.insert(h) and f.contains(h).all()
    f = line_dedup.CuckooFilter.load(f.dump())
    f.delete(h[:2500])
    assert f.contains(h[2500:]).all() and f.contains(h[:2500]).mean() < 0.01
    full = line_dedup.CuckooFilter(8)
    assert not full.insert(h[:200])


def fingerprint(t):
    import xxhash

    w = t.translate(LOW).split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, distance):
    fps = sorted({f for _, f in nodes})
    low = {f: min(i for i, g in nodes if g == f) for f in fps}
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    best = collections.defaultdict(lambda: BIG)
    for f in fps:
        best[root(f)] = min(best[root(f)], low[f])
    return {(i, f): best[root(f)] for i, f in nodes}


def test_simhash_classes(spark):
    nodes = [(i, fingerprint(t)) for i, t in raw()]
    want = components(nodes, 2)
    got = simhash.classes(docs(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        i = BIG if r.doc_id is None else r.doc_id
        assert (BIG if r.component_id is None else r.component_id) == want[(i, r.fp & (2**64 - 1))]
    assert simhash.classes(empty(spark)).count() == 0


def test_simhash_keeps_unlike_texts_of_one_id_apart(spark):
    far = lambda k: (fingerprint(prose(900, k).encode()) ^ fingerprint((prose(900, k) + " tail").encode())).bit_count()
    k = next(k for k in range(500) if 1 <= far(k) <= 2)
    rows = [(7, prose(60, 900)), (7, prose(900, k)), (3, prose(900, k) + " tail"), (None, prose(60, 901)), (None, prose(60, 902))]
    nodes = [(i, fingerprint(t)) for i, t in raw(rows)]
    want = components(nodes, 2)
    got = simhash.classes(docs(spark, rows)).collect()
    assert {(BIG if r.doc_id is None else r.doc_id, r.fp & (2**64 - 1)): BIG if r.component_id is None else r.component_id for r in got} == want


@pytest.mark.parametrize("large", [512, 3])
def test_pivot_links_lose_none(spark, large, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        f = int(b)
        for _ in range(20):  # chains and tight groups around each
            f ^= 1 << int(rng.integers(64))
            if rng.random() < 0.5:
                f ^= 1 << int(rng.integers(64))
            fps.add(f)
    nodes = [(k, f) for k, f in enumerate(sorted(fps))]
    monkeypatch.setattr(simhash, "LARGE", large)
    d = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, k) for k, f in nodes], "fp long, node long")
    edges = [tuple(r) for r in simhash.links(d).collect()]
    by = dict(nodes)
    assert all((by[a] ^ by[b]).bit_count() <= 64 for a, b in edges)
    up = {k: k for k, _ in nodes}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    want = components(nodes, 2)
    assert {(k, f): root(k) for k, f in nodes} == want


def repeats_expected(rows, m):
    seen = collections.Counter(t[i : i + m] for _, t in rows for i in range(len(t) - m + 1))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - m + 1):
            if seen[t[k : k + m]] > 1:
                gone[k : k + m] = True
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) > 0).sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return sorted(out)


@pytest.mark.parametrize(("hot", "sort"), [(1000, 1 << 20), (0, 2000)])
def test_suffix_dedup(spark, hot, sort, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", sort)
    monkeypatch.setattr(suffix_dedup, "PART", 5000)
    rows = ROWS
    got = sorted((BIG if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.cut_repeats(docs(spark, rows)).collect())
    assert got == repeats_expected(raw(rows), 200)
    assert suffix_dedup.cut_repeats(empty(spark)).count() == 0


def test_two_stage_order():
    rng = np.random.default_rng(1)
    for n, letters, m in ((3000, 2, 40), (4000, 4, 48), (1500, 1, 40), (3000, 26, 64)):
        d = rng.integers(0, letters, n).astype(np.uint8)
        w = rng.random(n) < 0.9
        w[n - m + 1 :] = False
        b = d.tobytes()
        order = suffix_dedup.two_stage_order(d, w, m)
        keys = [b[i : i + m] for i in order]
        assert sorted(order.tolist()) == np.flatnonzero(w).tolist() and keys == sorted(keys)
        seen = collections.Counter(b[i : i + m] for i in np.flatnonzero(w))
        hit = suffix_dedup.repeated(d, w, m)
        assert all(hit[i] == (seen[b[i : i + m]] > 1) for i in np.flatnonzero(w))


def test_ids_helper():
    assert BIG in ids()


def test_line_store_filter_holds_keys_it_wrongly_knew(monkeypatch):
    import pandas as pd

    key = lambda k: hashlib.md5(k.encode()).digest()
    delta = lambda k, n: pd.DataFrame({"shard": [0], "key": [key(k)], "n_docs": [n], "min_doc": [1], "reset": [False]})
    none = pd.DataFrame({c: [] for c in ("shard", "key", "n_docs", "min_doc", "filter")})
    old = line_dedup._merge((0,), none, delta("a", 1))
    with monkeypatch.context() as m:
        m.setattr(line_dedup.CuckooFilter, "contains", lambda self, h: np.ones(len(h), bool))
        old = line_dedup._merge((0,), old, delta("b", 1))
    held = line_dedup.CuckooFilter.load(old["filter"].dropna().iloc[0])
    assert held.contains(line_dedup._half(pd.Series([key("a"), key("b")]))).all()
    back = line_dedup._merge((0,), old, delta("b", -1))
    assert back["key"].dropna().tolist() == [key("a")]


@pytest.mark.parametrize("marks", [2, 65535])
def test_merge_keeps_exact_counts_whatever_the_filter_says(monkeypatch, marks):
    """Random batches of insertions and deletions against plain counts; with two fingerprints nearly all keys collide."""
    import random

    import pandas as pd

    places = line_dedup.CuckooFilter._places

    def few(self, h):
        f, a, _ = places(self, h)
        f = (f % marks + 1).astype(np.uint16)
        return f, a, a ^ self._hop(f)

    monkeypatch.setattr(line_dedup.CuckooFilter, "_places", few)
    r, refs = random.Random(marks), set()
    old = pd.DataFrame({c: [] for c in ("shard", "key", "n_docs", "min_doc", "filter")})
    key = lambda k: hashlib.md5(str(k).encode()).digest()
    for step in range(12):
        before = set(refs)
        if step % 3 == 2:
            gone = {r.randrange(40) for _ in range(15)}
            refs = {x for x in refs if x[1] not in gone}
        else:
            refs |= {(r.randrange(60), r.randrange(40)) for _ in range(80)}
        rows = []
        for k in {k for k, _ in before ^ refs}:
            own = [d for j, d in refs if j == k]
            n = len(own) - sum(j == k for j, _ in before)
            rows.append((0, key(k), n, min(own) if own else BIG, n < 0))
        delta = pd.DataFrame(rows, columns=["shard", "key", "n_docs", "min_doc", "reset"])
        old = line_dedup._merge((0,), old, delta)
        have = {(k, n, m) for k, n, m in zip(old["key"], old["n_docs"], old["min_doc"], strict=True) if k is not None}
        want = {(key(k), sum(j == k for j, _ in refs), min(d for j, d in refs if j == k)) for k, _ in refs}
        assert have == want and len(old) == len(want) + 1
        held = line_dedup.CuckooFilter.load(old["filter"].dropna().iloc[0])
        assert held.contains(line_dedup._half(pd.Series([key(k) for k, _ in refs]))).all()


def test_line_store_splits_its_shards(spark):
    rows = [(k, f"line number {k} of a text that is long enough\nand one that all texts have in common") for k in range(400)]
    store = line_dedup.LineStore.of(docs(spark, rows), keys_per_shard=3)
    assert store.shards > line_dedup.SHARDS
    assert store.counts().count() == 401 and store.state.where("key IS NOT NULL").groupBy("key").count().where("count > 1").isEmpty()
    assert kept_lines(store, docs(spark, rows)) == lines_expected(raw(rows))


def test_line_store_splits_before_it_merges(spark, monkeypatch):
    """No shard's task gets more keys than its bound, but for the hash's spread."""
    most, merges = 20, []
    held = line_dedup.LineStore._next

    def watched(store, delta):
        both = delta.select("key").unionByName(store.counts().select("key")).distinct()
        merges.append(both.groupBy(line_dedup._shard(store.shards).alias("s")).count().agg(F.max("count")).first()[0] or 0)
        return held(store, delta)

    monkeypatch.setattr(line_dedup.LineStore, "_next", watched)
    rows = [(k, "\n".join(f"line {k} {j} of many others" for j in range(10))) for k in range(600)]
    store = line_dedup.LineStore.of(docs(spark, rows), keys_per_shard=most)
    assert store.counts().count() == 6000 and store.shards == 512
    assert len(merges) >= 2 and max(merges) <= 2.5 * most


def test_hot_lines_are_broadcast(spark, monkeypatch):
    rows = [(k, f"a line that every document holds\nown line number {k}\nshared by two of them {k // 2}") for k in range(40)]
    store = line_dedup.LineStore.of(docs(spark, rows))
    want = kept_lines(store, docs(spark, rows))
    monkeypatch.setattr(line_dedup, "HOT", 5)
    assert kept_lines(store, docs(spark, rows)) == want and sum(r[2] for r in want) == 39 + 20
