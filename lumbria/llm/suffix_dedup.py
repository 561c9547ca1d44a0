"""Suffix-array dedup: bytes that lie in a string of MATCH bytes which also starts elsewhere are removed.

Equal windows of MATCH bytes hold the same k-grams, so the one whose hash is smallest (the anchor) is the same in both,
at the same place. A text's windows thus fall into runs with one anchor, and only runs with equal anchors can hold equal
windows. Runs whose anchor occurs once are dropped; the others are brought together by anchor as bytes, and there
their suffixes are sorted in two stages: those smaller than their successors directly, all others induced by bucket
scans. Neighbours with a common prefix of MATCH bytes are repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialised, release
from .textcols import blocks, flat, id_out, pick, small_batches, trimmed
from .tokens import _VALUE, mixed, span_hashes

MATCH = 200
GRAM = 32
#: Bytes that are sorted together: whole groups of one anchor, up to so many bytes.
SORT_BYTES = 1 << 20
#: A text longer than this is cut into parts that overlap by MATCH - 1 bytes; each window lies in one of them.
PART = 4 << 20
#: An anchor with more different runs is dealt window by window.
HOT_RUNS = 1000

_MULT = np.random.default_rng(6).integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers whose order is the bytes' order; data needs 7 bytes behind."""
    n = max(0, len(data) - 7)
    return np.ndarray((n,), ">u8", data.tobytes(), 0, (1,)).astype(np.uint64)


def runs(data: np.ndarray, off: np.ndarray, match: int = MATCH) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor) of every run of windows in the texts data[off[i]:off[i + 1]]."""
    n, k = len(data), min(GRAM, match)
    width = match - k + 1
    if n < match:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = _words(np.append(data, np.zeros(8, np.uint8)))
    with np.errstate(over="ignore"):
        g = np.zeros(n - k + 1, np.uint64)
        for j in range(k // 8):
            g = (g ^ x[8 * j : 8 * j + len(g)]) * _MULT[j]
            g ^= g >> np.uint64(29)
    g = mixed(g)
    low = (g & ~np.uint64(0xFFFFFF)) | np.arange(len(g), dtype=np.uint64)
    have = 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    first = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    ok = np.zeros(n + 1, np.int64)
    size = np.diff(off)
    long = size >= match
    np.add.at(ok, off[:-1][long], 1)
    np.add.at(ok, off[1:][long] - match + 1, -1)
    at = np.flatnonzero(np.cumsum(ok)[: len(first)] > 0)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    new = np.r_[True, (np.diff(first[at]) != 0) | (np.diff(at) != 1) | np.isin(at[1:], off)]
    begin = np.flatnonzero(new)
    return at[begin], np.diff(np.r_[begin, len(at)]), g[first[at[begin]]]


def _anchors(match: int, keys_only: bool = False):
    """The runs of all texts; keys_only: no more of them than their anchors."""
    names = ["key"] if keys_only else ["doc_id", "th", "p", "c", "key", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, off = flat(b.column(2))
            for i, j in blocks(off):
                whole = data[off[i] : off[j]]
                parts = range(0, max(1, len(whole) - match + 1), PART) if j == i + 1 and len(whole) > PART else (0,)
                for s in parts:
                    d = whole[s : s + PART + match - 1] if len(parts) > 1 else whole
                    o = np.array([0, len(d)]) if len(parts) > 1 else off[i : j + 1] - off[i]
                    p, c, key = runs(d, o, match)
                    if keys_only:
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=names)
                        continue
                    text = np.searchsorted(o, p, side="right") - 1
                    end = p + c + match - 1
                    cols = [ids[i + text], th[i + text], p - o[text] + s, c, key.view(np.int64), span_hashes(_VALUE[d], p, end).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n in "pc" else pa.int64()) for x, n in zip(cols, names, strict=True)], names=names)

    return run


def _field(col: pa.ListArray, name: str) -> np.ndarray:
    return col.flatten().field(name).to_numpy(zero_copy_only=False)


def _pieces(match: int):
    """The bytes of the runs asked for; of hot anchors, those of each window with its hash as the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(0))
            asked = b.column(1)
            text = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy(zero_copy_only=False))
            p, c, key, h, hot, twice = (_field(asked, f) for f in ("p", "c", "key", "h", "hot", "twice"))
            out: list[list] = [[], [], [], [], [], []]
            size = 0
            for k in range(len(text)):
                s = off[text[k]] + p[k]
                for w in range(c[k]) if hot[k] else (-1,):
                    piece = data[s : s + c[k] + match - 1] if w < 0 else data[s + w : s + w + match]
                    raw = piece.tobytes()
                    name = int(key[k]) if w < 0 else int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                    for col, v in zip(out, (name, key[k], h[k], max(w, 0), raw, bool(twice[k])), strict=True):
                        col.append(v)
                    size += len(raw)
                    if size > 4 << 20:
                        yield _rows(out)
                        out, size = [[] for _ in out], 0
            yield _rows(out)

    def _rows(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["group", "key", "h", "at", "raw", "twice"])

    return run


def two_stage_order(data: np.ndarray, wanted: np.ndarray, depth: int = MATCH) -> np.ndarray:
    """The wanted places of data in the order of their suffixes, as far as depth bytes tell them apart.

    Stage one: suffixes smaller than their successors are sorted by their bytes, eight at a time, ties only. Stage two:
    buckets of one first byte are scanned in ascending order; what precedes a scanned suffix, and is larger than it,
    comes next in its own bucket, and in each bucket the induced stand before the sorted.
    """
    n = len(data)
    t = np.append(data, np.zeros(depth + 16, np.uint8)).astype(np.int16)
    diff = np.sign(np.diff(t[: n + 1]))
    nz = np.where(diff != 0, np.arange(n), n)
    nz = np.minimum.accumulate(nz[::-1])[::-1]
    small = np.append(np.append(diff, 1)[nz] > 0, True)
    use = np.zeros(n + 1, bool)
    use[:n] = wanted
    stop = np.minimum.accumulate(np.where(small, np.arange(n + 1), n)[::-1])[::-1]
    ahead = np.zeros(n + 2, np.int64)
    at = np.flatnonzero(wanted)
    np.add.at(ahead, at, 1)
    np.add.at(ahead, stop[at] + 1, -1)
    use |= np.cumsum(ahead)[: n + 1] > 0
    x = _words(t.astype(np.uint8))
    place = np.flatnonzero(use & small)
    order = np.argsort(x[place], kind="stable")
    place = place[order]
    w = x[place]
    head = np.r_[True, w[1:] != w[:-1]] if len(w) else np.zeros(0, bool)
    for k in range(8, depth, 8):
        alone = head & np.r_[head[1:], True]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        sub, w = place[tied], x[place[tied] + k] if k + 8 <= depth else x[place[tied] + depth - 8]
        group = np.cumsum(head[tied])
        o = np.lexsort((w, group))
        place[tied] = sub[o]
        w, group = w[o], group[o]
        head[tied] = np.r_[True, (w[1:] != w[:-1]) | (group[1:] != group[:-1])]
    first = t[place]
    edge = np.searchsorted(first, np.arange(257))
    chunks: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        mine = []
        gen = np.concatenate(chunks[c]) if chunks[c] else np.zeros(0, np.int64)
        chunks[c] = []
        while len(gen):
            mine.append(gen)
            prev = gen[gen > 0] - 1
            gen = prev[use[prev] & ~small[prev] & (t[prev] == c)]
        mine.append(place[edge[c] : edge[c + 1]])
        bucket = np.concatenate(mine)
        out.append(bucket)
        prev = bucket[bucket > 0] - 1
        prev = prev[use[prev] & ~small[prev] & (t[prev] > c)]
        if len(prev):
            of = t[prev]
            o = np.argsort(of, kind="stable")
            prev, of = prev[o], of[o]
            cut = np.flatnonzero(np.diff(of)) + 1
            for part in np.split(prev, cut):
                chunks[t[part[0]]].append(part)
    order = np.concatenate(out)
    order = order[order < n]
    return order[wanted[order]]


def repeated(data: np.ndarray, wanted: np.ndarray, match: int = MATCH) -> np.ndarray:
    """Which wanted places begin a string of match bytes that another wanted place begins too."""
    order = two_stage_order(data, wanted, match)
    x = _words(np.append(data, np.zeros(match + 8, np.uint8)))
    pair = np.arange(len(order) - 1) if len(order) else np.zeros(0, np.int64)
    for k in [*range(0, match - 7, 8), *([match - 8] if match % 8 else [])]:
        pair = pair[x[order[pair] + k] == x[order[pair + 1] + k]]
    out = np.zeros(len(data), bool)
    out[order[pair]] = out[order[pair + 1]] = True
    return out


def _judged(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key, last = 0, None, (None, None)

        def judge() -> pa.RecordBatch:
            raws = [r for h in held for r in ((h[3], h[3]) if h[4] else (h[3],))]
            data = np.frombuffer(b"".join(raws), np.uint8)
            end = np.cumsum([len(r) for r in raws])
            wanted = np.ones(len(data), np.int64)
            for e in end:
                wanted[e - match + 1 : e] = 0
            hit, rows, k = repeated(data, wanted > 0, match), [], 0
            begin = np.r_[0, end]
            for k1, h, at, raw, twice in held:
                m = np.r_[False, hit[begin[k] : begin[k] + len(raw) - match + 1], False]
                d = np.diff(m.astype(np.int8))
                s, e = np.flatnonzero(d > 0), np.flatnonzero(d < 0)
                if len(s):
                    rows.append((k1, h, (s + at).tolist(), (e - s).tolist()))
                k += 2 if twice else 1
            return _verdicts(rows)

        for b in batches:
            for name, k1, h, at, raw, twice in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if name != key and size > SORT_BYTES:
                    yield judge()
                    held, size = [], 0
                if raw == last[1] and name == key:  # one more copy of a window: what holds for the first two holds for it
                    yield _verdicts([(k1, h, [at], [1])])
                    if not last[0]:
                        held[-1] = (*held[-1][:4], True)
                        last = (True, raw)
                    continue
                key, last = name, (twice, raw)
                held.append((k1, h, at, raw, twice))
                size += len(raw) * (2 if twice else 1)
        if held:
            yield judge()

    def _verdicts(rows: list[tuple]) -> pa.RecordBatch:
        cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "h", "s", "n"])

    return run


def _cut(match: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(1))
            spans = b.column(2)
            out = []
            for k, i in enumerate(b.column(0).to_pylist()):
                d = data[off[k] : off[k + 1]]
                begin = end = np.zeros(0, np.int64)
                got = spans[k]
                if got.is_valid and len(got):
                    s, n = (got.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("s", "n"))
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate((s + n + match - 1)[order])
                    apart = np.flatnonzero(s[1:] > e[:-1])
                    begin, end = s[np.r_[0, apart + 1]], e[np.r_[apart, len(e) - 1]]
                kept = b"".join(d[x:y].tobytes() for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(d)], strict=True))
                out.append((i, len(d), len(d) - len(kept), len(begin), kept))
            cols = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "kept" else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept, the bytes that stay.

    Every byte of a match-byte string that also starts elsewhere, in the same text or another, goes; all strings are
    judged on the input. match is a multiple of 8 and at least 40. Equal runs, told by the
    anchor's hash and a second one over all their bytes, are one class: it is sorted twice with the rest, and its members
    share the verdict, so that thousands of copies cost two. Anchors with over
    HOT_RUNS different runs are dealt by window instead, and equal windows meet one by one. Texts travel once: the
    exchange by id serves both the runs' bytes and the result. Null texts are empty; rows that repeat id and text
    count as two places; texts shorter than match stay whole; a null id counts as the largest; an empty table gives an
    empty one. A long text is cut into overlapping parts for its anchors, some 60 bytes a byte of a part; besides, a task
    holds it twice, and the spans that go.
    """
    if match % 8 or match < GRAM + 8:
        raise ValueError("match: a multiple of 8, at least 40")
    small_batches(docs)
    d = pick(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")
    a = d.mapInArrow(trimmed(_anchors(match)), "doc_id long, th long, p int, c int, key long, h long")
    keys = d.select("doc_id", "th", "text").mapInArrow(trimmed(_anchors(match, keys_only=True)), "key long")
    many = materialised(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "anchors")
    release(docs.sparkSession)
    some = materialised(a.join(many, "key", "left_semi"), "runs")
    release(docs.sparkSession)
    place = F.struct("doc_id", "th", "p", "c")
    kinds = some.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
    per = kinds.groupBy("key").agg((F.count(F.lit(1)) > HOT_RUNS).alias("hot"))
    ask = kinds.join(per, "key").select("at.doc_id", "at.th", F.struct("at.p", "at.c", "key", "h", "hot", (F.col("n") > 1).alias("twice")).alias("run"))
    ask = ask.groupBy("doc_id", "th").agg(F.collect_list("run").alias("asked"))
    raw = d.join(ask.hint("shuffle_hash"), ["doc_id", "th"]).select("text", "asked").mapInArrow(trimmed(_pieces(match)), "group long, key long, h long, at int, raw binary, twice boolean")
    verdict = raw.repartition("group").sortWithinPartitions("group", "raw").mapInArrow(trimmed(_judged(match)), "key long, h long, s array<int>, n array<int>")
    spans = some.join(verdict, ["key", "h"]).select("doc_id", "th", F.transform(F.arrays_zip("s", "n"), lambda x: F.struct((x["s"] + F.col("p")).alias("s"), x["n"].alias("n"))).alias("r"))
    spans = spans.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("r")).alias("r"))
    out = d.join(spans.hint("shuffle_hash"), ["doc_id", "th"], "left").select("doc_id", "text", "r").mapInArrow(trimmed(_cut(match)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", id_out(F.col("doc_id")))


def op3_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
