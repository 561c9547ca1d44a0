"""Line dedup over shards: cuckoo filters in front of exact reference-count tables, with insertion and deletion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialised
from .textcols import ASCII_LOWER, NULL_ID, id_in, id_out, pick, small_batches, trimmed

#: Stripped at both ends of a line.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_POINTS = 10
SLOTS = 4
#: Keys of a shard, above which shards are split; shards that a store has at least; batches that a store is built in.
KEYS, SHARDS, BATCHES = 100_000, 64, 2
#: A line is hot if more documents hold it than this and than one of MOST_HOT parts of all postings.
HOT, MOST_HOT = 1_000, 10_000


def line_key(line: bytes) -> bytes | None:
    """128-bit key of a line: stripped, A-Z lower-cased; None if it has fewer than MIN_POINTS code points."""
    k = line.strip(SPACE)
    if len(k) < MIN_POINTS or len(k) - sum(1 for c in k if c & 0xC0 == 0x80) < MIN_POINTS:
        return None
    return xxhash.xxh3_128_digest(k.translate(ASCII_LOWER))


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; an entry may sit in either of two buckets, so it can be deleted again."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        self.n = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.8)))))
        self.table = np.zeros((self.n, SLOTS), np.uint16) if table is None else table.reshape(-1, SLOTS)
        self.n = len(self.table)

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(1, np.frombuffer(blob, np.uint16).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        a = (h & np.uint64(self.n - 1)).astype(np.int64)
        return f, a, a ^ self._hop(f)

    def _hop(self, f: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((f.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (self.n - 1)

    def contains(self, h: np.ndarray) -> np.ndarray:
        f, a, b = self._places(h)
        return (self.table[a] == f[:, None]).any(1) | (self.table[b] == f[:, None]).any(1)

    def insert(self, h: np.ndarray) -> bool:
        """Puts in all of h, most of them at once; False if the table is too full: build a larger one."""
        f, a, b = self._places(h)
        for first in (True, False, True, False):
            if not len(f):
                return True
            at = a if first else b
            order = np.argsort(at, kind="stable")
            f, a, b, at = f[order], a[order], b[order], at[order]
            new = np.r_[True, at[1:] != at[:-1]]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            empty = self.table[at] == 0
            room = empty.sum(1)
            ok = nth < room
            slot = np.argsort(~empty, axis=1, kind="stable")[np.arange(len(at)), np.minimum(nth, SLOTS - 1)]
            self.table[at[ok], slot[ok]] = f[ok]
            f, a, b = f[~ok], a[~ok], b[~ok]
        rng = np.random.default_rng(7)
        for x, at in zip(f, a, strict=True):
            for _ in range(500):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = x
                    break
                s = rng.integers(SLOTS)
                x, self.table[at, s] = self.table[at, s], x
                at = int(at ^ self._hop(np.array([x], np.uint16))[0])
            else:
                return False
        return True

    def delete(self, h: np.ndarray) -> None:
        """Takes out one entry for each of h; only what was inserted may be deleted."""
        for f, a, b in zip(*self._places(h), strict=True):
            for at in (a, b):
                hit = np.flatnonzero(self.table[at] == f)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break


def _half(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2] if len(keys) else np.zeros(0, np.uint64)


def _built(keys: pd.Series) -> CuckooFilter:
    h, room = _half(keys), max(64, int(len(keys) * 1.2))
    while not (c := CuckooFilter(room)).insert(h):
        room *= 2
    return c


_STATE = "shard int, key binary, n_docs long, min_doc long, filter binary"


def _merge(_key: tuple, old: pd.DataFrame, delta: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter and exact table after a batch of signed reference counts.

    Keys that the filter doesn't know are new without a look at the table; only the others are looked up there. Whatever
    enters the table enters the filter, keys that it wrongly knew included, and only what leaves the table leaves it.
    Where delta says reset, its min_doc takes the place of the table's. Taking away what isn't there changes nothing.
    """
    shard = int((delta if len(delta) else old)["shard"].iloc[0])
    blob = old["filter"].dropna()
    table = old[old["key"].notna()]
    c = CuckooFilter.load(blob.iloc[0]) if len(blob) else None
    known = c.contains(_half(delta["key"])) if c is not None and len(delta) else np.zeros(len(delta), bool)
    maybe = np.flatnonzero(known)
    at = pd.Index(table["key"], dtype=object).get_indexer(delta["key"].iloc[maybe]) if len(maybe) else np.zeros(0, np.int64)
    n, low = table["n_docs"].to_numpy(np.int64, copy=True), table["min_doc"].to_numpy(np.int64, copy=True)
    dn, dlow = delta["n_docs"].to_numpy(np.int64), delta["min_doc"].to_numpy(np.int64)
    met, place = maybe[at >= 0], at[at >= 0]
    n[place] += dn[met]
    low[place] = np.where(delta["reset"].to_numpy(bool)[met], dlow[met], np.minimum(low[place], dlow[met]))
    new = np.ones(len(delta), bool)
    new[met] = False
    new &= dn > 0
    stay = n > 0
    keys = [*table["key"][stay], *delta["key"][new]]
    if c is not None:
        c = c if c.insert(_half(delta["key"][new])) else None
        if c is not None:
            c.delete(_half(table["key"][~stay]))
    c = c or _built(pd.Series(keys, dtype=object))
    none = [None] * len(keys)
    return pd.DataFrame({"shard": shard, "key": [None, *keys], "n_docs": np.r_[0, n[stay], dn[new]], "min_doc": np.r_[0, low[stay], dlow[new]], "filter": [c.dump(), *none]})


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, keys = [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            own = {k for line in t.split(b"\n") if (k := line_key(line)) is not None}
            ids += [i] * len(own)
            keys += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, t, drop in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            lines = t.split(b"\n")
            drop = set(drop or ())
            left = [x for x in lines if line_key(x) not in drop] if drop else lines
            rows.append((i, len(lines), len(lines) - len(left), b"\n".join(left)))
        cols = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])


class LineStore:
    """Line references of a growing and shrinking set of documents.

    Held as two tables in the shared folder: postings (key, doc_id), the exact references, and state, per shard a cuckoo
    filter and the exact table key -> (documents, smallest document). Keys are dealt to shards by hash, and reference
    counts are aggregated before they are dealt, so a line that a third of all documents hold is one row. A store is
    built by inserting its documents in batches. insert() and delete() return a new store; the older one stays valid, and
    deleting what was inserted restores it. Shards are split in two, before a batch is merged, as often as its keys and
    those held would outgrow keys_per_shard.
    A document is its id: rows that repeat an id are one holder. A null id counts as the largest. Null text: one empty
    line. Empty tables give empty stores.
    """

    def __init__(self, postings: DataFrame, state: DataFrame, shards: int, keys_per_shard: int = KEYS):
        self.postings, self.state, self.shards, self.keys_per_shard = postings, state, shards, keys_per_shard

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys_per_shard: int = KEYS, batches: int = BATCHES) -> LineStore:
        postings = materialised(cls._found(docs, id_col, text_col), "lines")
        store = cls(postings.limit(0), docs.sparkSession.createDataFrame([], _STATE), SHARDS, keys_per_shard)
        for k in range(batches):
            store = store._with(postings.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
        return cls(postings, store.state, store.shards, keys_per_shard)

    @staticmethod
    def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        small_batches(docs)
        return pick(docs, id_col, text_col).mapInArrow(trimmed(_postings), "doc_id long, key binary")

    def _next(self, delta: DataFrame) -> DataFrame:
        delta = delta.withColumn("shard", _shard(self.shards))
        return materialised(self.state.groupBy("shard").cogroup(delta.groupBy("shard")).applyInPandas(_merge, _STATE), "line-state")

    def _with(self, new: DataFrame) -> LineStore:
        """The store after references that it doesn't hold yet. Shards are made for what they will hold before it comes."""
        gained = new.select("key", "doc_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("min_doc"))
        gained = materialised(gained.withColumn("reset", F.lit(False)), "line-gains")
        room = self._sized(self.counts().count() + gained.count())
        return LineStore(self.postings.unionByName(new), room._next(gained), room.shards, self.keys_per_shard)

    def _sized(self, keys: int) -> LineStore:
        """Twice as many shards, and again, until so many keys are within bounds; filters are built anew."""
        shards = self.shards
        while keys > shards * self.keys_per_shard:
            shards *= 2
        if shards == self.shards:
            return self
        empty = LineStore(self.postings, self.state.limit(0), shards, self.keys_per_shard)
        return LineStore(self.postings, empty._next(self.counts().withColumn("reset", F.lit(False))), shards, self.keys_per_shard)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineStore:
        """Documents not yet held are added; of documents that are, only references that are not held already."""
        found = materialised(self._found(docs, id_col, text_col), "lines")
        again = found.select("doc_id").distinct().join(self.postings.select("doc_id").distinct(), "doc_id")
        first = found.join(again, "doc_id", "left_anti")
        more = found.join(again, "doc_id", "left_semi").join(self.postings.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
        return self._with(materialised(first.unionByName(more), "lines"))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineStore:
        """Takes the references of these documents out; the smallest holder is found anew among those that stay."""
        gone = ids.select(id_in(ids[id_col]).alias("doc_id")).distinct()
        left = materialised(self.postings.join(gone, "doc_id", "left_anti").select("doc_id", "key"), "lines")
        lost = self.postings.join(gone, "doc_id", "left_semi").select("key", "doc_id").distinct().groupBy("key").agg((-F.count(F.lit(1))).alias("n_docs"))
        low = left.join(lost.select("key"), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("min_doc"))
        delta = lost.join(low, "key", "left").select("key", "n_docs", F.coalesce("min_doc", F.lit(NULL_ID)).alias("min_doc"), F.lit(True).alias("reset"))
        return LineStore(left, self._next(delta), self.shards, self.keys_per_shard)

    def counts(self) -> DataFrame:
        return self.state.where("key is not null").select("key", "n_docs", "min_doc")

    def _shared(self, min_docs: int) -> DataFrame:
        """(key, doc_id, n_docs, min_doc) of the keys that min_docs documents hold. Keys of a large part of all postings,
        of which there are at most MOST_HOT, are broadcast, so that none of them is one task's."""
        shared = self.counts().where(F.col("n_docs") >= min_docs)
        most = max(HOT, -(-self.postings.count() // MOST_HOT))
        hot = materialised(shared.where(F.col("n_docs") > most), "hot-lines")
        if hot.isEmpty():
            return self.postings.join(shared, "key")
        rest = self.postings.join(F.broadcast(hot.select("key")), "key", "left_anti").join(shared.where(F.col("n_docs") <= most), "key")
        return self.postings.join(F.broadcast(hot), "key").unionByName(rest)

    def kept(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2) -> DataFrame:
        """Per row of docs: doc_id, n_lines, n_dropped and kept_text. A key that min_docs documents hold loses all its
        lines but those of the smallest document."""
        small_batches(docs)
        drops = self._shared(min_docs).where("doc_id <> min_doc").select("doc_id", "key").groupBy("doc_id").agg(F.collect_set("key").alias("drop"))
        rows = pick(docs, id_col, text_col).join(drops.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "drop")
        out = rows.mapInArrow(trimmed(_cut), "doc_id long, n_lines long, n_dropped long, kept_text string")
        return out.withColumn("doc_id", id_out(F.col("doc_id")))


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def op6_line_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = LineStore.of(docs).kept(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL_OP6 = r"""
WITH l AS (
  SELECT d.doc_id, u.i, u.line, translate(regexp_replace(regexp_replace(u.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d, LATERAL (SELECT unnest(ls) AS line, unnest(range(len(ls))) AS i) u
), s AS (SELECT k, min(doc_id) AS m FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT l.*, s.m IS NOT NULL AND l.doc_id <> s.m AS gone FROM l LEFT JOIN s USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id"""
