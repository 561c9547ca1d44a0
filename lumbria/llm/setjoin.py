"""Jaccard join of shingle sets: subsets of fixed size for light sets, inverted lists for heavy ones."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from ..operators.components import connected_components
from ..session import materialised, release
from .textcols import ASCII_LOWER, give_back, id_out, pick, small_batches, trimmed
from .tokens import mixed

#: Words of a shingle, and the least share of the union, in percent, that linked sets have in common.
WORDS, PERCENT = 5, 80
#: Sets of more shingles than this are never light; a comparison costs so many times what a key costs.
MOST_LIGHT, COMPARE = 64, 0.2
#: Frequent shingles go last in the order of all sets: those of so many documents at least, and so many shingles at most.
FREQUENT, MOST_FREQUENT = 32, 1 << 20
#: Text whose shingles are counted together, bins of a small set's outline, and bytes of a group that one task compares.
CHUNK, BINS, BLOCK = 8 << 20, 64, 8 << 20
#: Words whose hashes a worker keeps.
MEMORY = 1 << 18

_FULL = np.iinfo(np.uint8).max


class Shingles:
    """Hashes of texts' word shingles. A word is hashed by its bytes; a shingle mixes its words' hashes one by one."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ascending distinct hashes of each text's shingles; a text of fewer words has its whole sequence as one."""
        parts = [t.translate(ASCII_LOWER).split() for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        known = self.known
        for p in parts:
            for w in set(p).difference(known):
                known[w] = xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for p in parts for w in p), np.uint64, sum(map(len, parts)))
        out, s, full = [], 0, self._mixed([h[k : len(h) - self.words + 1 + k] for k in range(self.words)] if len(h) >= self.words else [])
        for p in parts:
            e = s + len(p)
            if len(p) >= self.words:
                out.append(np.unique(full[s : e - self.words + 1]))
            else:
                out.append(self._mixed([h[k : k + 1] for k in range(s, e)]))
            s = e
        return out

    @staticmethod
    def _mixed(columns: list[np.ndarray]) -> np.ndarray:
        if not columns:
            return np.zeros(0, np.uint64)
        out = np.full(len(columns[0]), len(columns), np.uint64)
        with np.errstate(over="ignore"):
            for c in columns:
                out = mixed((out ^ c) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        return out


def apart(n: int, percent: int) -> int:
    """Shingles of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


def bins_of(n: int) -> int:
    """Bins of the outline of a set of n: a power of two, so that a bin counts four shingles or fewer on average."""
    return max(BINS, 1 << max(0, -(-n // 4) - 1).bit_length())


def outline(s: np.ndarray) -> bytes:
    """How many of the set's hashes fall into each bin: two sets have in common at most the sum of the smaller counts. A
    count of _FULL stands for any larger one too."""
    b = bins_of(len(s))
    return np.minimum(np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b), _FULL).astype(np.uint8).tobytes()


def _counted(words: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held, size = Shingles(words), [], 0

        def often() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

        for b in batches:
            held += make.sets(b.column(1).cast(pa.binary()).to_pylist())
            size += b.nbytes
            if size >= CHUNK:
                yield often()
                size = 0
        yield often()

    return run


def frequent(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """The shingles that many documents hold, ascending, MOST_FREQUENT at most.

    All documents' shingles are counted by chunks, and counts over one are summed up: a shingle that d of all documents
    hold meets itself in a chunk about d * d / chunks times, so that one of over the root of FREQUENT * chunks is found.
    They only decide the order in which sets are read, never a result."""
    small = docs.mapInArrow(_counted(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = small.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toArrow()
    return np.sort(top["h"].to_numpy().view(np.uint64))


def _rare_first(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    if not len(last):
        return s
    late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
    return np.concatenate([s[~late], s[late]])


def _sets(words: int, percent: int, last: Broadcast):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(words)
        for b in batches:
            sets = make.sets(b.column(1).cast(pa.binary()).to_pylist())
            key = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            heads = [_rare_first(s, last.value)[: apart(len(s), percent) + 2].view(np.int64) for s in sets]
            off = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int64), *heads])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.ascontiguousarray(key[:, 0])), pa.array(np.ascontiguousarray(key[:, 1])), pa.array([len(s) for s in sets], pa.int64()), keys, pa.array([outline(s) for s in sets], pa.binary())], names=["doc_id", "k1", "k2", "n", "head", "bins"])

    return run


def subset_keys(head: np.ndarray) -> np.ndarray:
    """A key for each two of the first shingles of a light set: sets that are linked have one of them in common."""
    a, b = np.array([*combinations(range(len(head)), 2)], np.int64).reshape(-1, 2).T
    x, y = np.minimum(head[a], head[b]), np.maximum(head[a], head[b])
    return mixed(x ^ mixed(y + np.uint64(2)))


def _postings(percent: int, light: int, both: bool):
    """Keys of sets of (node, n, head). Sets of up to `light` shingles have the keys of their subsets (kind 1), larger
    ones their first shingles as such (kind 0), as do light ones that may be linked to these. both: each kind for all."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, off, flat = b.column(1).to_numpy(), b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy().view(np.uint64)
            single, own = (100 * size >= percent * (light + 1)) | both, (size <= light) | both
            keys, rows, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            # Apart from the shingle that only subsets take, the first shingles as they lie.
            place = np.arange(off[0], off[-1]) - np.repeat(off[:-1], np.diff(off))
            wide = np.repeat(np.arange(len(size)), np.diff(off))
            some = single[wide] & (place <= (size - -(-percent * size // 100))[wide])
            keys.append(flat[off[0] : off[-1]][some])
            rows.append(wide[some])
            kinds.append(np.zeros(int(some.sum()), np.int32))
            for k in np.flatnonzero(own & (size > 1)).tolist():
                two = subset_keys(flat[off[k] : off[k + 1]])
                keys.append(two)
                rows.append(np.full(len(two), k))
                kinds.append(np.ones(len(two), np.int32))
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), b.column(0).take(pa.array(at)), pa.array(size[at]), pa.array(np.concatenate(kinds))], names=["key", "node", "n", "kind"])

    return run


_POSTED = "key long, node long, n long, kind int"


def boundary(classes: DataFrame, percent: int = PERCENT) -> int:
    """The size up to which sets are light, by cost: keys, and comparisons in the lists that keys bring together, are
    counted for all sets of up to MOST_LIGHT shingles, with subsets and with inverted lists, and the cheapest size taken."""
    small = classes.where(f"n BETWEEN 1 AND {MOST_LIGHT}").select("node", "n", "head").mapInArrow(_postings(percent, 0, both=True), _POSTED)
    own = small.groupBy("kind", "key", "n").agg(F.count(F.lit(1)).alias("m"))
    lists = small.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("all"))
    cost = own.join(lists, ["kind", "key"]).groupBy("kind", "n").agg(F.sum(F.col("m") * (1 + COMPARE * (F.col("all") - 1) / 2)).alias("cost"))
    found = {(r.kind, r.n): r.cost for r in cost.collect()}
    total = lambda x: sum(found.get((int(n <= x), n), 0.0) for n in range(1, MOST_LIGHT + 1)) + sum(found.get((0, n), 0.0) for n in range(-(-percent * (x + 1) // 100), x + 1))
    return min(range(MOST_LIGHT + 1), key=total)


@trimmed
def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, without those whose key stands alone; a list of any length passes through."""
    held, marked = None, False
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            key = t["key"].to_numpy()
            same = key[1:] == key[:-1]
            keep = np.r_[marked, same] | np.r_[same, False]
            yield from t.slice(0, len(key) - 1).filter(pa.array(keep[:-1])).to_batches()
            held, marked = t.slice(len(key) - 1).to_batches()[0], bool(keep[-1])
    if marked:
        yield held


def _unlike(lists: DataFrame) -> DataFrame:
    """One of all lists (grp, node) with the same nodes, known by their number, ends and two hashes of all: near copies
    meet under most of their keys."""
    marks = [F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b")]
    one = lists.groupBy("grp").agg(*marks).groupBy("n", "low", "high", "a", "b").agg(F.min("grp").alias("grp"))
    return lists.join(one.select("grp"), "grp")


class Outlines:
    """Members by their bins: what two have in common at most, against what linked sets need; no link has it negative."""

    def __init__(self, n: np.ndarray, loads: list[bytes], percent: int):
        self.n, self.percent, self.loads = n, percent, loads
        self.width = np.array([bins_of(k) for k in n.tolist()], np.int64)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _counts(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts in so many bins of all members whose outline has as many or twice as many, and each member's row among
        them; full counts are beyond all others."""
        if width not in self.known:
            parts, at = [], np.full(len(self.n), -1)
            for w in (width, 2 * width):
                own = np.flatnonzero(self.width == w)
                if len(own):
                    at[own] = sum(map(len, parts)) + np.arange(len(own))
                    c = np.frombuffer(b"".join(self.loads[k][:w] for k in own.tolist()), np.uint8).reshape(len(own), w).astype(np.uint16)
                    c[c == _FULL] = 1 << 14
                    parts.append(c if w == width else c[:, :width] + c[:, width:])
            self.known[width] = np.concatenate(parts), at
        return self.known[width]

    def excess(self, h: int, others: np.ndarray) -> np.ndarray:
        out = np.full(len(others), -1, np.int64)
        n = self.n[others]
        fits = 100 * np.minimum(n, self.n[h]) >= self.percent * np.maximum(n, self.n[h])
        width = np.minimum(self.width[others], self.width[h])
        for w in set(width[fits].tolist()):
            some = np.flatnonzero(fits & (width == w))
            counts, at = self._counts(w)
            step = max(1, (1 << 20) // w)
            for i in range(0, len(some), step):
                part = some[i : i + step]
                low = np.minimum(counts[at[h]], counts[at[others[part]]])
                out[part] = (100 + self.percent) * low.sum(1, dtype=np.int64) - self.percent * (self.n[h] + n[part])
        return out


class Wholes(Outlines):
    """Members by all their shingles, each load being the outline and the ascending hashes: what two have in common."""

    def __init__(self, n: np.ndarray, loads: list[bytes], percent: int):
        super().__init__(n, loads, percent)
        self.sets = [np.frombuffer(x, np.uint64, offset=w) for x, w in zip(loads, self.width.tolist(), strict=True)]

    def excess(self, h: int, others: np.ndarray) -> np.ndarray:
        out = super().excess(h, others)
        own = self.sets[h]
        near = np.flatnonzero(out >= 0)
        if len(near):
            sets = [self.sets[k] for k in others[near].tolist()]
            all_ = np.concatenate(sets)
            has = own[np.minimum(np.searchsorted(own, all_), len(own) - 1)] == all_
            both = np.add.reduceat(has.astype(np.int64), np.cumsum([0, *map(len, sets[:-1])]))
            out[near] = (100 + self.percent) * both - self.percent * (self.n[h] + self.n[others[near]])
        return out


def _tree(members: Outlines) -> tuple[list[int], list[int]]:
    """Edges that connect what links connect: from a member all that are not connected yet are looked at, then from those
    found, the likest first. A group of near copies is one star, as soon as its centre is looked at."""
    left, src, dst = np.arange(len(members.n)), [], []
    while len(left) > 1:
        queue, left = [(0, int(left[0]))], left[1:]
        while queue and len(left):
            h = heappop(queue)[1]
            more = members.excess(h, left)
            hit = more >= 0
            for x, k in zip(more[hit].tolist(), left[hit].tolist(), strict=True):
                heappush(queue, (-x, k))
                src.append(h)
                dst.append(k)
            left = left[~hit]
    return src, dst


def _groups(kind: type[Outlines], percent: int, block: int):
    """Edges of groups that follow one another; those of over `block` bytes are left to blocks."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[int, int, bytes]] = []
        now, size = None, 0

        def edges() -> Iterator[tuple[int, int]]:
            if len(own) > 1 and size <= block:
                node, n, loads = zip(*own, strict=True)
                for a, b in zip(*_tree(kind(np.array(n, np.int64), list(loads), percent)), strict=True):
                    yield node[a], node[b]

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["src", "dst"])

        for b in batches:
            found: list[tuple[int, int]] = []
            for grp, node, n, load in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if grp != now:
                    found += edges()
                    own, now, size = [], grp, 0
                size += _bytes(len(load))
                if size <= block:
                    own.append((node, n, load))
            yield out(found)
        yield out(list(edges()))

    return run


def _bytes(load):
    """What a member counts for in a task: for a length in bytes or a column of lengths."""
    return load + 64


def _to_first(kind: type[Outlines], percent: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, load, n1, load1 = (b.column(c).to_pylist() for c in (2, 3, 5, 6))
            pair = lambda k: kind(np.array([n1[k], n[k]], np.int64), [load1[k], load[k]], percent)  # noqa: E731, B023
            ok = [bool(pair(k).excess(0, np.array([1]))[0] >= 0) for k in range(len(n))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(5)), pa.array(ok, pa.bool_())], names=["grp", "node", "n", "load", "first", "ok"])

    return run


def _blocks(kind: type[Outlines], percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Edges between a block of members that are not like the first of their group, and any block of it; the right
        side's members that are like the first are connected already."""
        both = pa.concat_tables([t.select(["node", "n", "load", "ok"]) for t in (left, right)])
        node, ok = both["node"].to_numpy(), both["ok"].to_numpy()
        members = kind(both["n"].to_numpy(), both["load"].to_pylist(), percent)
        lab = np.where(ok, len(node), np.arange(len(node)))
        src, dst = [], []
        for h in range(left.num_rows):
            others = left.num_rows + np.flatnonzero((lab[left.num_rows :] != lab[h]) & (node[left.num_rows :] != node[h]))
            others = others[members.excess(h, others) >= 0]
            one, at = np.unique(lab[others], return_index=True)
            src += [int(node[h])] * len(one)
            dst += node[others[at]].tolist()
            lab[np.isin(lab, one)] = lab[h]
        give_back()
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def connecting(members: DataFrame, loads: DataFrame, kind: type[Outlines], percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Edges (src, dst) that connect, within each group of members (grp, node), all nodes whose loads (node, n, load) link.

    A group of at most `block` bytes is one task's. Of a larger one, members like the first need no look at one another;
    all others are compared with the whole group, block by block. Both ways connect the same."""
    sized = members.join(loads.select("node", F.length("load").alias("size")), "node")
    large = sized.groupBy("grp").agg(F.sum(_bytes(F.col("size"))).alias("bytes"), F.min("node").alias("first")).where(F.col("bytes") > block)
    large = materialised(large, "large")
    near = members if large.isEmpty() else members.join(large, "grp", "left_anti")
    rows = near.join(loads, "node").select("grp", "node", "n", "load")
    out = rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(_groups(kind, percent, block), "src long, dst long")
    if large.isEmpty():
        return out
    first = large.join(loads, F.col("first") == F.col("node")).select("grp", "first", F.col("n").alias("n1"), F.col("load").alias("load1"))
    rows = members.join(large.select("grp"), "grp").join(loads, "node").join(first, "grp").select("grp", "node", "n", "load", "first", "n1", "load1")
    seen = materialised(rows.mapInArrow(_to_first(kind, percent), "grp long, node long, n long, load binary, first long, ok boolean"), "seen")
    parts = lambda rows: F.ceil(F.sum(F.when(rows, _bytes(F.length("load"))).otherwise(0)) / block).cast("int")
    size = seen.groupBy("grp").agg(parts(~F.col("ok")).alias("a"), parts(F.lit(True)).alias("b")).where("a > 0")
    deal = lambda d, n, other: d.join(size, "grp").select(*(F.col(x).alias(x) for x in ("grp", "node", "n", "load", "ok")), F.pmod(F.xxhash64("node"), n).cast("int").alias(f"_{n}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"_{other}"))
    key = ["grp", "_a", "_b"]
    rest = deal(seen.where("NOT ok"), "a", "b").groupBy(*key).cogroup(deal(seen, "b", "a").groupBy(*key)).applyInArrow(_blocks(kind, percent), "src long, dst long")
    return out.unionByName(seen.where("ok AND node <> first").select(F.col("node").alias("src"), F.col("first").alias("dst"))).unionByName(rest)


def _wholes(words: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(words)
        for b in batches:
            sets = make.sets(b.column(1).cast(pa.binary()).to_pylist())
            key = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.ascontiguousarray(key[:, 0])), pa.array(np.ascontiguousarray(key[:, 1])), pa.array([outline(s) + s.tobytes() for s in sets], pa.binary())], names=["low", "k1", "k2", "load"])

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the size of its set of word shingles, and the smallest doc_id
    that links reach, itself included. Two sets link if they have percent / 100 of their union or more in common.

    Equal sets are one class, so copies are never paired. All sets are read in one order, frequent shingles last; linked
    sets of n shingles have one of their n - ceil(percent * n / 100) + 1 first in common, and two of one more. Sets of up
    to boundary() shingles are light: they are listed under each two of these. Heavier ones are listed under each, and
    their lists scanned. Outlines drop what can't link; what lists propose is compared by whole sets, and only
    within what proposals connect. Lists and groups of any size are dealt in blocks of bounded bytes.

    A null, empty or blank text has an empty set and links with nothing; a text of fewer words than a shingle has its
    sequence as one. A null id counts as the largest and comes out null. Repeated ids are rows of their own. An empty
    table gives an empty one; other columns take no part, whatever their names. A long text's set is held in one piece,
    8 bytes a shingle. Shingles are told by 64-bit hashes, sets by 128.
    """
    small_batches(docs)
    spark, texts = docs.sparkSession, pick(docs, id_col, text_col)
    last = spark.sparkContext.broadcast(frequent(texts, words))
    sets = materialised(texts.mapInArrow(_sets(words, percent, last), "doc_id long, k1 long, k2 long, n long, head array<long>, bins binary"), "sets")
    best = sets.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.first(F.struct("n", "head", "bins")).alias("s"))
    own = materialised(best.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "low", "s.n", "s.head", F.col("s.bins").alias("load")), "classes")
    release(spark)
    posted = own.select("node", "n", "head").mapInArrow(_postings(percent, boundary(own, percent), both=False), _POSTED)
    lists = posted.select("key", "node").repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, "key long, node long")
    lists = materialised(_unlike(materialised(lists.select(F.col("key").alias("grp"), "node"), "lists")), "lists")
    release(spark)
    proposed = connected_components(materialised(connecting(lists, own.select("node", "n", "load"), Outlines, percent, block).distinct(), "proposed"))
    found = materialised(proposed.join(own.select("node", "k1", "k2", "low", "n"), "node"), "found")
    release(spark)
    again = texts.join(found.select(F.col("low").alias("doc_id")).distinct(), "doc_id", "left_semi")
    whole = again.mapInArrow(_wholes(words), "low long, k1 long, k2 long, load binary").dropDuplicates(["low", "k1", "k2"])
    loads = materialised(whole.join(found, ["low", "k1", "k2"]).select("node", "n", "load"), "loads")
    links = connecting(found.select(F.col("component").alias("grp"), "node"), loads, Wholes, percent, block)
    linked = materialised(connected_components(materialised(links, "links")).join(own.select("node", "k1", "k2", "low"), "node"), "linked")
    named = linked.join(linked.groupBy("component").agg(F.min("low").alias("best")), "component").select("k1", "k2", "best")
    named = own.select("k1", "k2", "low").join(named, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("best", "low").alias("best"))
    out = sets.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles")).join(named, ["k1", "k2"], "left")
    return out.select(id_out(F.col("doc_id")).alias("doc_id"), "n_shingles", id_out(F.coalesce("best", "doc_id")).alias("component_id"))


def op11_heavy_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
