"""SimHash near-dedup: fingerprints, and links found with tables of distances to pivot fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators.components import connected_components
from ..session import materialised, release
from .textcols import ASCII_LOWER, give_back, id_out, pick, small_batches, trimmed
from .tokens import mixed

SEED = 42
#: Blocks of bits that a key needs unchanged, and pivots besides the common one that a block has.
SAME, PER_BLOCK = 3, 8
#: Near copies by words: so many fingerprints of a text's set of words, two of which lie within so many bits; and the
#: bits within which the fingerprints of their five-word shingles lie.
WORD_PRINTS, WORD_BITS, SHINGLE_BITS = 6, 5, 18
#: Buckets with more fingerprints than this are dealt anew by a second table of pivots.
LARGE = 4096


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 majority bits over the hashes of all word shingles, repeats included; 0 without words."""
    parts = text.translate(ASCII_LOWER).split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(whole, SEED)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    pairs = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    h = np.array(list(map(xxh64_intdigest, [whole[a:b] for a, b in pairs], repeat(SEED))), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "th", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, th, fp) for every row, th being a hash of the text; a null text is empty and has fingerprint 0."""
    small_batches(docs)
    return pick(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).mapInArrow(trimmed(_prints(words)), "doc_id long, th long, fp long")


def word_prints(text: bytes, count: int = WORD_PRINTS) -> list[int]:
    """Majority bits over the hashes of the distinct words, under so many independent hashes; zeros without words.

    One changed word moves one element of this set but five of the five-word shingles, so that texts which share four
    fifths of their shingles differ in few bits here.
    """
    words = set(text.translate(ASCII_LOWER).split())
    if not words:
        return [0] * count
    h = np.fromiter(map(xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    out = []
    for k in range(count):
        g = mixed(h ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) if k else h
        ones = np.zeros(64, np.int64)
        for i in range(0, len(g), 1 << 14):
            ones += np.unpackbits(g[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(g), bitorder="little").view(np.uint64)[0]))
    return out


def _near_prints(words: int):
    names = ["doc_id", "th", *(f"w{k}" for k in range(WORD_PRINTS)), "s"]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            cols = [*zip(*(word_prints(t) for t in texts), strict=True)] or [()] * WORD_PRINTS
            cols.append([fingerprint(t, words) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols)], names=names)

    return run


class Pivots:
    """Reference fingerprints: a random common one, and for each block of bits variants of it that differ in the block.

    The distances to a variant and to the common pivot differ by an amount that only the block's bits decide. Two
    fingerprints within `distance` bits agree on all but `distance` blocks of same + distance, and so in all those
    differences over some `same` blocks: these make the keys. Over the whole table, no coordinate of such a pair differs
    by more than `distance`, by the triangle inequality.
    """

    #: Pairs that are looked at together.
    PAIRS = 1 << 19

    def __init__(self, distance: int, seed: int, same: int = SAME):
        rng = np.random.default_rng(seed)
        self.distance, self.same, self.blocks = distance, same, same + distance
        bits = rng.permutation(64)
        self.common = int(rng.integers(0, 2**63, dtype=np.uint64)) << 1 | 1
        self.variants: list[list[int]] = []
        for block in np.array_split(bits, self.blocks):
            masks = []
            for k in range(PER_BLOCK):
                part = rng.permutation(block)[: max(1, len(block) // 2 + k % 3 - 1)]
                masks.append(self.common ^ sum(1 << int(b) for b in part))
            self.variants.append(masks)
        self.all = np.array([self.common, *(m for b in self.variants for m in b)], np.uint64)

    def keys(self, fp: np.ndarray) -> np.ndarray:
        """(fingerprints, keys): one key per choice of `same` blocks, from the differences of distances there."""
        combos = list(combinations(range(self.blocks), self.same))
        table = np.bitwise_count(fp[:, None] ^ self.all).astype(np.int8)
        sig = np.ascontiguousarray(table[:, 1:] - table[:, :1]).view(np.uint64)
        out = np.empty((len(fp), len(combos)), np.uint64)
        with np.errstate(over="ignore"):
            for n, c in enumerate(combos):
                h = np.full(len(fp), n, np.uint64)
                for k in c:
                    h = mixed((h ^ sig[:, k]) * np.uint64(0x9E3779B97F4A7C15))
                out[:, n] = h
        return out

    def key_rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(fp, s, node, key) with key null or a first key, to a row per key of keys(), joined to the first key."""
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                keys = self.keys(part.column(0).to_numpy().view(np.uint64))
                n = keys.shape[1]
                if part.column(3).null_count == 0:
                    keys = mixed(keys ^ mixed(part.column(3).to_numpy().view(np.uint64))[:, None])
                wide = lambda c: pa.array(np.repeat(part.column(c).to_numpy(), n))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([wide(0), wide(1), wide(2), pa.array(keys.ravel().view(np.int64))], names=["fp", "s", "node", "key"])

    def forest(self, fp: np.ndarray, bucket: np.ndarray, known: np.ndarray, second: np.ndarray | None = None, apart: int = 64) -> np.ndarray:
        """Of each fingerprint the smallest index that links within its bucket reach: those within the distance, and
        within `apart` bits of the second fingerprints. bucket: ascending numbers; known: the smallest index that each is
        connected to beforehand. Coordinate 0 is sorted and windowed, then all other coordinates are compared, then the
        bits; pairs that are connected already are left out first, so that a group of copies costs no pairs."""
        table = np.bitwise_count(fp[:, None] ^ self.all).astype(np.int8)
        place = bucket.astype(np.int64) * 256 + table[:, 0]
        order = np.argsort(place, kind="stable")
        fp, table, place, n = fp[order], table[order], place[order], len(fp)
        second = None if second is None else second[order]
        at = np.empty(n, np.int64)
        at[order] = np.arange(n)
        lab = at[known[order]]
        ahead = np.searchsorted(place, place + self.distance, side="right") - np.arange(n) - 1
        total = np.r_[0, np.cumsum(ahead)]
        s = 0
        while s < n:
            e = max(s + 1, int(np.searchsorted(total, total[s] + self.PAIRS, side="right")) - 1)
            m = ahead[s:e]
            a = np.repeat(np.arange(s, e), m)
            b = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m) + a + 1
            new = lab[a] != lab[b]
            a, b = a[new], b[new]
            for c in range(1, table.shape[1]):
                near = np.abs(table[a, c] - table[b, c]) <= self.distance
                a, b = a[near], b[near]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= self.distance
            if second is not None:
                near &= np.bitwise_count(second[a] ^ second[b]) <= apart
            if near.any():
                lab = _labels(n, lab[a[near]], lab[b[near]])[lab]
            s = e
        low = np.full(n, n)
        np.minimum.at(low, lab, order)
        out = np.empty(n, np.int64)
        out[order] = low[lab]
        return out


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        new = np.minimum(new, new[lab])
        if (new == lab).all():
            break
        lab = new
    return lab


def _edges(pivots: Pivots, apart: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 4

        def of(key: np.ndarray, fp: np.ndarray, second: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            """Edges of whole buckets, all at once; buckets of one are left out."""
            same = np.r_[False, key[1:] == key[:-1]]
            many = np.flatnonzero(same | np.r_[same[1:], False])
            key, fp, second, node = key[many], fp[many].view(np.uint64), second[many].view(np.uint64), node[many]
            bucket = np.cumsum(np.r_[False, key[1:] != key[:-1]]) if len(key) else key
            order = np.lexsort((node, bucket))
            node = node[order]
            new = np.r_[True, (node[1:] != node[:-1]) | (bucket[1:] != bucket[:-1])] if len(node) else np.zeros(0, bool)
            known = np.maximum.accumulate(np.where(new, np.arange(len(node)), 0))
            lab = pivots.forest(fp[order], bucket, known, second[order] if apart < 64 else None, apart)
            moved = np.flatnonzero(new & (node != node[lab]))
            return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[lab[moved]])], names=["src", "dst"])

        for b in batches:
            cols = [np.concatenate([k, b.column(c).to_numpy()]) for c, k in enumerate(kept)]
            if not len(cols[0]):
                continue
            last = np.searchsorted(cols[0], cols[0][-1])
            if last:
                yield of(*(c[:last] for c in cols))
            kept = [c[last:] for c in cols]
        yield of(*kept)

    return run


_KEYED = "fp long, s long, node long, key long"


def links(prints: DataFrame, distance: int = 2, same: int = SAME, apart: int = 64) -> DataFrame:
    """Edges (src, dst) that connect all fingerprints within distance of one another, and within apart bits of one
    another's second fingerprints where prints have a column s.

    prints: (fp, node), with s if apart is under 64; rows of one node are connected already, and no edge says so. Keys of Pivots bring together what may be linked. A bucket
    is searched by its pivot table and gives a spanning forest, not its pairs. Buckets of over LARGE fingerprints are
    dealt anew by the keys of a second table over other blocks, which is exact as well: fingerprints are distinct and
    two keys fix most of their bits, so no bucket grows with the input beyond that. Which side of LARGE a bucket is on
    decides the way, never the result. Keys are computed twice, to be counted and to be dealt, and not written.
    """
    first, second = Pivots(distance, 1, same), Pivots(distance, 2, same)
    plain = prints.select("fp", (F.col("s") if apart < 64 else F.lit(0).cast("long")).alias("s"), "node", F.lit(None).cast("long").alias("key"))
    rows = plain.mapInArrow(trimmed(first.key_rows), _KEYED)
    large = materialised(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE), "large")
    rows = rows.join(large, "key", "left")
    again = rows.where("n IS NOT NULL").select("fp", "s", "node", "key").mapInArrow(trimmed(second.key_rows), _KEYED)
    rows = rows.where("n IS NULL").select("key", "fp", "s", "node").unionByName(again)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_edges(first, apart), "src long, dst long")


def near_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, th, w0.., s, node) for every row: fingerprints of the set of words and of the shingles, and their hash."""
    small_batches(docs)
    kind = ", ".join(["doc_id long, th long", *(f"w{k} long" for k in range(WORD_PRINTS)), "s long"])
    rows = pick(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).mapInArrow(_near_prints(words), kind)
    return rows.withColumn("node", F.xxhash64(*(f"w{k}" for k in range(WORD_PRINTS)), "s"))


def near_components(prints: DataFrame) -> DataFrame:
    """(node, component) of the nodes of near_prints() that links connect: some two fingerprints of the words within
    WORD_BITS, those of the shingles within SHINGLE_BITS.

    The second condition is why chance doesn't connect a large corpus: unlike texts of one topic may have like words,
    but of 64 bits of their shingles about 32 differ. The first fingerprints are linked alone; the others only link what
    these have left apart, so that a large group is found once and not again by each.
    """
    nodes = materialised(prints.select(*(f"w{k}" for k in range(WORD_PRINTS)), "s", "node").distinct(), "nodes")
    linked = lambda d, k, node: materialised(links(d.select(F.col(f"w{k}").alias("fp"), "s", F.col(node).alias("node")), WORD_BITS, 2, SHINGLE_BITS).distinct(), "links")
    first = connected_components(linked(nodes, 0, "node"))
    nodes = materialised(nodes.join(first, "node", "left").withColumn("so_far", F.coalesce("component", "node")), "nodes")
    out = None
    for k in range(1, WORD_PRINTS):
        release(prints.sparkSession)
        e = linked(nodes, k, "so_far")
        out = e if out is None else out.unionByName(e)
    then = connected_components(out).select(F.col("node").alias("so_far"), F.col("component").alias("last"))
    return nodes.join(then, "so_far", "left").where("component IS NOT NULL OR last IS NOT NULL").select("node", F.coalesce("last", "so_far").alias("component"))


def components(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """(fp, component) for the fingerprints of nodes that are linked to others; a component is named by its smallest."""
    return connected_components(links(nodes.select("fp", F.col("fp").alias("node")), distance)).withColumnRenamed("node", "fp")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, th, fp, component_id) for every row; component_id: the smallest doc_id reachable over links.

    Fingerprints are the nodes, whatever ids their rows have: groups of copies cost a row each and are never paired, and
    unlike texts under one id, or under none, stay apart. Texts without words have fingerprint 0 and are linked like any
    other; a null id counts as the largest.
    """
    rows = materialised(fingerprints(docs, id_col, text_col, words), "prints")
    nodes = materialised(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    linked = materialised(nodes.join(components(nodes, distance), "fp"), "linked")
    best = linked.groupBy("component").agg(F.min("low").alias("best"))
    named = nodes.join(linked.join(best, "component").select("fp", "best"), "fp", "left").select("fp", F.coalesce("best", "low").alias("component_id"))
    return rows.join(named, "fp").select(id_out(F.col("doc_id")).alias("doc_id"), "th", "fp", id_out(F.col("component_id")).alias("component_id"))


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for t in b.column(3).cast(pa.binary()).to_pylist():
                p = t.translate(ASCII_LOWER).split()
                n = max(1, len(p) - words + 1) if p else 0
                sets.append(np.unique(np.fromiter((xxh64_intdigest(b" ".join(p[i : i + words]), SEED) for i in range(n)), np.uint64, n)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sets, pa.binary())], names=["component", "doc_id", "th", "s"])

    return run


def alike(a: bytes, b: bytes, least: float) -> bool:
    """Whether two sets of shingle hashes have this Jaccard similarity; two empty sets have."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def _like_first(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(x, y, least) for x, y in zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(5)), pa.array(ok, pa.bool_())], names=["component", "doc_id", "th", "s", "first", "ok"])

    return run


def _connected(left: list[tuple[int, bytes]], others: list[tuple[int, bytes]], known: list[int], least: float) -> tuple[list[int], list[int]]:
    """Edges from left's texts to others, as a forest: of texts that are connected already no pair is compared. known:
    texts that are connected beforehand, as all of them are like the first of their class."""
    up = dict.fromkeys(known, known[0]) if known else {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    sets = {th: frozenset(np.frombuffer(s, np.uint64).tolist()) for th, s in (*left, *others)}
    src, dst = [], []
    for th, _ in left:
        x = sets[th]
        for o, _ in others:
            y = sets[o]
            if min(len(x), len(y)) < least * max(len(x), len(y)) or (a := root(th)) == (b := root(o)):
                continue
            both = len(x & y)
            if both >= least * (len(x) + len(y) - both):
                up[a] = b
                src.append(th)
                dst.append(o)
    return src, dst


def _like_rest(least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = lambda t: list(zip(t["th"].to_pylist(), t["s"].to_pylist(), strict=True))
        src, dst = _connected(rows(left), rows(right), [o for o, ok in zip(right["th"].to_pylist(), right["ok"].to_pylist(), strict=True) if ok], least)
        give_back()
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _like_small(least: float):
    """_like_rest for whole classes that follow one another."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[int, bytes, bool]] = []
        now = None

        def edges() -> tuple[list[int], list[int]]:
            return _connected([x[:2] for x in own if not x[2]], [x[:2] for x in own], [x[0] for x in own if x[2]], least)

        for b in batches:
            src, dst = [], []
            for component, *row in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if component != now:
                    for col, more in zip((src, dst), edges(), strict=True):
                        col.extend(more)
                    own, now = [], component
                own.append(tuple(row))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in edges()], names=["src", "dst"])

    return run


def verified(docs: DataFrame, found: DataFrame, words: int = 5, least: float = 0.8, block: int = 1 << 20) -> DataFrame:
    """(th, class) of the texts that Jaccard pairs connect within the classes of found (doc_id, th, component).

    Texts like the first of their class need no look at one another. All others are compared with the whole class: at
    once where it has at most `block` bytes of shingles, else in blocks against blocks; both give the same classes.
    """
    small_batches(docs)
    members = found.groupBy("component", "th").agg(F.min("doc_id").alias("doc_id"))
    many = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th")).alias("f")).where("n > 1")
    texts = pick(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
    rows = texts.join(members.join(many.select("component"), "component"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    sets = materialised(rows.select("component", "doc_id", "th", "text").mapInArrow(trimmed(_shingles(words)), "component long, doc_id long, th long, s binary"), "shingles")
    first = sets.join(many.select("component", "f.*"), ["component", "doc_id", "th"]).select("component", F.col("th").alias("first"), F.col("s").alias("fs"))
    kind = "component long, doc_id long, th long, s binary, first long, ok boolean"
    seen = materialised(sets.join(first, "component").select("component", "doc_id", "th", "s", "first", "fs").mapInArrow(trimmed(_like_first(least)), kind), "seen")
    parts = lambda d: F.ceil(F.sum(F.length("s") + 64) / block).cast("int").alias(d)
    size = seen.groupBy("component").agg(F.count_if(~F.col("ok")).alias("n"), F.ceil(F.sum(F.when(~F.col("ok"), F.length("s") + 64)) / block).cast("int").alias("a"), parts("b")).where("n > 0")
    small = seen.join(size.where("b = 1").select("component"), "component").select("component", "th", "s", "ok")
    near = small.repartition("component").sortWithinPartitions("component").mapInArrow(_like_small(least), "src long, dst long")
    large = size.where("b > 1")
    deal = lambda d, n, other: d.join(large, "component").select(*(F.col(x).alias(x) for x in ("component", "th", "s", "ok")), F.pmod("th", n).cast("int").alias(f"_{n}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"_{other}"))
    key = ["component", "_a", "_b"]
    rest = deal(seen.where("not ok"), "a", "b").groupBy(*key).cogroup(deal(seen, "b", "a").groupBy(*key)).applyInArrow(_like_rest(least), "src long, dst long")
    rest = rest.unionByName(near)
    edges = seen.where("ok").select(F.col("th").alias("src"), F.col("first").alias("dst")).unionByName(rest)
    return connected_components(materialised(edges, "alike")).select(F.col("node").alias("th"), F.col("component").alias("class"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
