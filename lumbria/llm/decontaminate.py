"""Benchmark decontamination over a distributed positional inverted index of the training texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialised
from .textcols import blocks, flat, id_out, lowered, pick, small_batches, trimmed
from .tokens import word_spans

#: Words of a window.
WINDOW = 13
#: Texts of a segment hold so many bytes together, or are one longer text.
SEGMENT_BYTES = 1 << 20
#: Test items are searched in blocks of so many bytes of text. A block takes about 2.5 times that, in a task as on the
#: driver: its words, a number per word and where windows begin.
BLOCK_BYTES = 4 << 20
#: Windows that are intersected together.
TOGETHER = 4096

_SEGMENT = "doc_ids array<long>, token_at array<long>, terms binary, list_at binary, places binary, words binary, word_at binary"


def _dictionary(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of the words that begin at starts[first], one after another, and their offsets."""
    size = ends[first] - starts[first]
    at = np.r_[0, np.cumsum(size)]
    return low[np.repeat(starts[first] - at[:-1], size) + np.arange(at[-1])].tobytes(), at


def _word_runs(tok: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, list_at): places by hash, equal words together and ascending, and where each word's list begins. Words of
    one hash are compared with the first of them; where they differ, the words themselves part the lists."""
    order = np.argsort(tok, kind="stable")
    new = np.r_[True, tok[order[1:]] != tok[order[:-1]]] if len(tok) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    size = ends - starts
    first = order[np.flatnonzero(new)][run]
    unlike = size[order] != size[first]
    n = np.where(unlike, 0, size[order])
    at = np.cumsum(n) - n
    step = np.arange(n.sum()) - np.repeat(at, n)
    differs = low[np.repeat(starts[order], n) + step] != low[np.repeat(starts[first], n) + step]
    if len(differs):
        some = np.flatnonzero(n)
        unlike[some] |= np.logical_or.reduceat(differs, at[some])
    for r in np.unique(run[unlike]).tolist():
        a, b = np.searchsorted(run, [r, r + 1])
        own = sorted(order[a:b].tolist(), key=lambda k: (low[starts[k] : ends[k]].tobytes(), k))
        order[a:b] = own
        new[a + 1 : b] = [low[starts[x] : ends[x]].tobytes() != low[starts[y] : ends[y]].tobytes() for x, y in zip(own[:-1], own[1:], strict=True)]
    return order, np.flatnonzero(new)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5]
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        data, off = flat(b.column(1))
        for i, j in blocks(off, SEGMENT_BYTES):
            low = lowered(data[off[i] : off[j]])
            tok, starts, ends, at = word_spans(low, off[i : j + 1] - off[i])
            order, list_at = _word_runs(tok, low, starts, ends)
            terms = tok[order[list_at]]
            words, word_at = _dictionary(low, starts, ends, order[list_at] if len(tok) else order)
            row = (ids[i:j].tolist(), at.tolist(), terms.tobytes(), np.r_[list_at, len(tok)].astype(np.uint32).tobytes(), order.astype(np.uint32).tobytes(), words, word_at.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], names=["doc_ids", "token_at", "terms", "list_at", "places", "words", "word_at"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a table of segments. A segment holds whole texts; per distinct word its ascending token places and
    itself, in order of the words' hashes, and where each text's tokens begin. No row is shuffled: a phrase can't leave
    its text, so postings stay with their segment, and any number of segments is searched side by side."""
    small_batches(docs)
    segments = pick(docs, id_col, text_col).mapInArrow(trimmed(_segments), _SEGMENT)
    return materialised(segments.withColumn("segment", F.monotonically_increasing_id()), "index")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per item its words, space-joined, and their hashes."""
    for b in batches:
        data, off = flat(b.column(1))
        low = lowered(data)
        tok, starts, ends, at = word_spans(low, off)
        words = [b" ".join(low[s:e].tobytes() for s, e in zip(starts[i:j], ends[i:j], strict=True)) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tok[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array(words, pa.binary())], names=["item_id", "terms", "words"])


class _Phrases:
    """A block of items: all their terms one after another, and by length where windows begin and whose they are."""

    def __init__(self, rows: list):
        items = [(r["item_id"], np.frombuffer(bytes(r["terms"]), np.uint64)) for r in rows]
        words = [w for r in rows for w in bytes(r["words"]).split(b" ") if w]
        number: dict[bytes, int] = {}
        self.of = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
        self.words = list(number)
        self.known = np.zeros(len(number), np.uint64)
        self.known[self.of] = np.concatenate([np.zeros(0, np.uint64), *(t for _, t in items)])
        begins: dict[int, list] = {}
        at = 0
        for i, t in items:
            if len(t):
                n = min(WINDOW, len(t))
                begins.setdefault(n, []).append((np.arange(at, at + len(t) - n + 1, dtype=np.int32), i))
                at += len(t)
        self.groups = [(n, np.concatenate([s for s, _ in own]), np.repeat(np.array([i for _, i in own], np.int64), [len(s) for s, _ in own])) for n, own in sorted(begins.items())]

    def _found(self, terms: np.ndarray, words: bytes, word_at: np.ndarray) -> np.ndarray:
        """Number in the segment of each known word, -1 if it isn't there. Hashes find it, the word itself decides."""
        low, high = (np.searchsorted(terms, self.known, side=side) for side in ("left", "right"))
        out = np.full(len(self.known), -1, np.int64)
        for k in np.flatnonzero(low < high).tolist():
            for t in range(low[k], high[k]):
                if words[word_at[t] : word_at[t + 1]] == self.words[k]:
                    out[k] = t
        return out

    def search(self, segment: tuple[np.ndarray, ...], token_at: np.ndarray, slop: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Token places hit, and (text number, item) pairs. The rarest term's list proposes starts; the other lists,
        shifted by the terms' offsets, are intersected in order of their lengths. With slop, a term may stand so many
        places off its own."""
        terms, list_at, places, words, word_at = segment
        hit = np.zeros(len(places), bool)
        pairs: set[tuple[int, int]] = set()
        if not len(terms) or not len(self.known):
            return hit, []
        sizes = np.diff(list_at)
        at = self._found(terms, words, word_at)[self.of]
        gaps = np.r_[0, np.cumsum(at < 0)]
        keyed = None
        for n, begin, items in self.groups:
            some = np.flatnonzero(gaps[begin + n] == gaps[begin])
            if len(some) and keyed is None:
                keyed = (np.repeat(np.arange(len(terms), dtype=np.int64), sizes) << 32) + places
            for s in range(0, len(some), TOGETHER):
                part = some[s : s + TOGETHER]
                met, win = self._met(at[begin[part][:, None] + np.arange(n)], sizes, list_at, places, keyed, slop)
                if not len(win):
                    continue
                text = np.searchsorted(token_at, met.min(1), side="right") - 1
                ok = met.max(1) < token_at[text + 1]
                hit[met[ok].ravel()] = True
                pairs.update(zip(text[ok].tolist(), items[part[win[ok]]].tolist(), strict=True))
        return hit, sorted(pairs)

    @staticmethod
    def _met(t: np.ndarray, sizes: np.ndarray, list_at: np.ndarray, places: np.ndarray, keyed: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Token places of the occurrences of windows t, rows of term numbers, and the row of each."""
        n = t.shape[1]
        order = np.argsort(sizes[t], axis=1, kind="stable")
        rare = t[np.arange(len(t)), order[:, 0]]
        count = sizes[rare]
        win = np.repeat(np.arange(len(t)), count)
        start = places[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + list_at[rare][win]].astype(np.int64) - order[win, 0]
        met = np.zeros((len(win), n), np.int64)
        met[np.arange(len(win)), order[win, 0]] = start + order[win, 0]
        for k in range(1, n):
            c = order[win, k]
            low = np.maximum(start + c - slop, 0)
            key = t[win, c] << 32
            at = np.minimum(np.searchsorted(keyed, key + low), len(keyed) - 1)
            ok = (keyed[at] >= key + low) & (keyed[at] <= key + start + c + slop)
            met[np.arange(len(win)), c] = keyed[at] & 0xFFFFFFFF
            win, start, met = win[ok], start[ok], met[ok]
        return met, win


def _searched(phrases: _Phrases, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, token_at = b.column(0)[k].as_py(), np.array(b.column(1)[k].as_py(), np.int64)
                terms, list_at, places, word_at = (np.frombuffer(b.column(c)[k].as_buffer() or b"", d) for c, d in ((2, np.uint64), (3, np.uint32), (4, np.uint32), (6, np.uint32)))
                hit, pairs = phrases.search((terms, list_at.astype(np.int64), places, b.column(5)[k].as_py(), word_at), token_at, slop)
                items: list[list[int]] = [[] for _ in ids]
                for d, i in pairs:
                    items[d].append(i)
                at = np.flatnonzero(hit)
                cut = np.searchsorted(at, token_at)
                words = [(at[cut[d] : cut[d + 1]] - token_at[d]).tolist() for d in range(len(ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.diff(token_at)), pa.array(words, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64())), pa.array([f"{b.column(7)[k].as_py()}:{d}" for d in range(len(ids))])],
                    names=["doc_id", "n_words", "hit_words", "items", "row"],
                )

    return run


def matches(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", slop: int = 0) -> DataFrame:
    """Per text of the index: doc_id, n_words, hit_words (places of the words that any found window covers) and items
    (ids of the items with a found window). slop 0: exact phrases; more: proximity, each term at most so far off.

    Items are searched in blocks of BLOCK_BYTES of their texts, so what the driver and a task hold is bounded however
    many items there are; each block is a pass over the index, and what all of them hit is put together by text once.
    Repeated words, items and texts count as they stand; a text or item without words has no window; null texts are empty;
    an empty index gives an empty table, and without items nothing is hit. Words are found by a 64-bit hash and compared.
    """
    t = pick(items, id_col, text_col, "item_id", "text")
    size = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    small_batches(index)
    kind = "doc_id long, n_words long, hit_words array<long>, items array<long>, row string"
    parts = []
    for k in range(n):
        found = t.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).mapInArrow(trimmed(_terms), "item_id long, terms binary, words binary").collect()
        parts.append(index.mapInArrow(trimmed(_searched(_Phrases(found), slop)), kind))
    if n == 1:
        out = parts[0]
    else:
        hits = reduce(DataFrame.unionByName, [materialised(p.where("size(items) > 0").select("row", "hit_words", "items"), "hits") for p in parts])
        every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(f"_{c}")
        hits = hits.groupBy("row").agg(every("hit_words"), every("items"))
        empty = F.array().cast("array<long>")
        texts = index.mapInArrow(trimmed(_searched(_Phrases([]), slop)), kind).select("doc_id", "n_words", "row")
        out = texts.join(hits, "row", "left").select("doc_id", "n_words", F.coalesce("_hit_words", empty).alias("hit_words"), F.coalesce("_items", empty).alias("items"))
    return out.select("doc_id", "n_words", "hit_words", "items").withColumn("doc_id", id_out(F.col("doc_id")))


def op7_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = matches(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = F.size("hit_words").cast("long")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def contaminated():
    """The contract's rule on hit_words and n_words: hit at all, and at least a twentieth of the words."""
    hits = F.size("hit_words")
    return (hits > 0) & (20 * hits >= F.col("n_words"))


SQL_OP7 = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM low),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS p
        FROM bw, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i) u WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM win),
g AS (SELECT w.doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS p FROM w, lens, LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS i) u),
m AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM g JOIN win ON g.p = win.p AND g.n = win.n),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, LATERAL (SELECT unnest(range(0, n)) AS k) u GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""
