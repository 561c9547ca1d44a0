"""Periodic runs of words: aligned blocks searched in the document, matches at fitting distances extended both ways."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from ahocorasick import KEY_SEQUENCE, STORE_INTS, Automaton
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcols import id_out, pick, small_batches, trimmed

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 24, 3
#: Words of a block that make its key, and words of a document whose blocks are searched at once.
KEY, SEGMENT = 64, 1 << 16

_RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Finder:
    """All runs of one document's words, given as numbers.

    Blocks of b = 2**k words start at the multiples of b. Runs with a period q from b to 2b - 1 (from 1 for the smallest
    b) have q + 2b - 1 words or more: their first 2b - 1 words hold a whole block, and its copy q words on is in the run
    too. So blocks are sought up to 2b words on, by the first KEY words at most, and each match at a fitting distance is
    extended over all equal words on both sides. A stretch of three periods or more with a period that isn't its
    smallest is the very stretch that its smallest period has, and that was found before.
    """

    def __init__(self, words: np.ndarray, least: int = LEAST, times: int = TIMES):
        if times < 3:
            raise ValueError("a run has three periods at least")
        self.words, self.n, self.least, self.times = words, len(words), least, times
        self.seq = tuple(words.tolist())
        self.found: dict[tuple[int, int], int] = {}

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period), by start, then period."""
        block, low = 1 << (((self.least + 2) // 3).bit_length() - 1), 1
        while self.n >= max(self.least, self.times * low):
            self._scale(block, low)
            block = low = 2 * block
        return sorted(((s, e - s, q) for (s, e), q in self.found.items()), key=lambda r: (r[0], r[2]))

    def _scale(self, block: int, low: int) -> None:
        ahead = sorted(((s, e, q) for (s, e), q in self.found.items()), reverse=True)
        within: list[tuple[int, int, int]] = []
        reach: dict[int, int] = {}
        span = max(SEGMENT, 4 * block)
        for a in range(0, self.n, span):
            for p, q in self._matches(a, min(a + span, self.n), block, low):
                while ahead and ahead[-1][0] <= p:
                    within.append(ahead.pop())
                if within:
                    within = [r for r in within if r[1] > p]
                # In a run that repeats after a part of q, or in a stretch that was looked at, nothing is new.
                if reach.get(q, 0) > p or any(q % r == 0 and p + q + min(block, KEY) <= e for _, e, r in within):
                    continue
                s, t = self._extended(p, q)
                reach[q] = t
                if t - s + q >= max(self.least, self.times * q):
                    e = t + q
                    self.found[s, e] = min(q, self.found.get((s, e), q))
                    within.append((s, e, q))

    def _matches(self, a: int, z: int, block: int, low: int) -> list[tuple[int, int]]:
        """(p, q), by p: the block at p, in a..z, is found q words on, q from low to 2 * block - 1."""
        size = min(block, KEY)
        starts: dict[tuple[int, ...], list[int]] = {}
        for p in range(a, min(z, self.n - size + 1), block):
            starts.setdefault(self.seq[p : p + size], []).append(p)
        if not starts:
            return []
        search = Automaton(STORE_INTS, KEY_SEQUENCE)
        for k, key in enumerate(starts):
            search.add_word(key, k)
        search.make_automaton()
        at: list[list[int]] = [[] for _ in starts]
        for end, k in search.iter(self.seq[a : z + 3 * block]):
            at[k].append(a + end + 1 - size)
        out = []
        for own, places in zip(starts.values(), at, strict=True):
            if len(places) > 1:
                for p in own:
                    out.extend((p, o - p) for o in places[bisect_left(places, p + low) : bisect_left(places, p + 2 * block)])
        return sorted(out)

    def _extended(self, p: int, q: int) -> tuple[int, int]:
        """The widest s..t around p in which each word equals the one q on."""
        w, n = self.words, self.n
        t, step = p, KEY
        while t < n - q:
            m = min(step, n - q - t)
            off = w[t : t + m] != w[t + q : t + q + m]
            k = int(off.argmax())
            if off[k]:
                t += k
                break
            t, step = t + m, 2 * step
        s, step = p, KEY
        while s > 0:
            m = min(step, s)
            off = w[s - m : s] != w[s - m + q : s + q]
            if off.any():
                s -= int(off[::-1].argmax())
                break
            s, step = s - m, 2 * step
        return s, t


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number, and the word of each number."""
    known: dict[bytes, int] = {}
    parts = text.split()
    return np.fromiter((known.setdefault(p, len(known)) for p in parts), np.int64, len(parts)), list(known)


def _found(least: int, times: int, rewritten: Callable[[int | None, np.ndarray], np.ndarray] | None):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, kept = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words, names = numbered(t)
                if rewritten:
                    words = rewritten(i, words)
                own = Finder(words, least, times).runs()
                gone = np.zeros(len(words) + 1, np.int64)
                for s, size, q in own:
                    gone[s + q] += 1
                    gone[s + size] -= 1
                runs.append([{"start": s, "length": size, "period": q} for s, size, q in own])
                kept.append(b" ".join(map(names.__getitem__, words[np.cumsum(gone)[:-1] == 0].tolist())).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, kind), pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, rewritten: Callable[[int | None, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) for every row: all runs of words by start, then period, and the text's words joined by
    one blank without those that a run holds after its first period.

    Words are what ASCII white space separates, compared byte by byte. rewritten(id, word numbers) may change a document's
    words before runs are sought; it is given the largest long for a null id. A null, empty or blank text has no runs and
    an empty collapsed text. Repeated rows are found again each, null ids stay null, an empty table gives an empty one;
    other columns take no part, whatever their names. A text is dealt with in one piece, with about 150 bytes a word in
    the worker; blocks are searched by segments, so that an automaton never grows with the text.
    """
    small_batches(docs)
    out = pick(docs, id_col, text_col).mapInArrow(_found(least, times, rewritten), _RUNS)
    return out.withColumn("doc_id", id_out(F.col("doc_id")))


def looped(doc_id: int, words: np.ndarray) -> np.ndarray:
    """The contract's planted loops: in one of ten documents, by its id, all words from a place on repeat the first few."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return words[np.where(at >= a, a + (at - a) % p, at)]


def steepest(runs: Column) -> Column:
    """The run with the greatest length over period, by exact fractions; of equals the first, then of the least period."""

    def order(x: Column, y: Column) -> Column:
        more = y["length"] * x["period"] - x["length"] * y["period"]
        return F.sign(F.coalesce(F.nullif(more, F.lit(0)), F.nullif(x["start"] - y["start"], F.lit(0)), x["period"] - y["period"])).cast("int")

    return F.get(F.array_sort(runs, order), 0)


def op12_block_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewritten=looped)
    best = found.withColumn("best", steepest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
