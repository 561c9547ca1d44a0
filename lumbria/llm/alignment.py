"""Cross-tokenizer alignment: groups of tokens between common ends, and how often the corpus links two vocabularies' ids."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import materialised
from .textcols import id_out, pick, small_batches, trimmed
from .tokens import mixed, span_hashes

#: A block's dictionary of groups is closed once it has seen so many bytes of text or holds so many groups.
BLOCK_BYTES, BLOCK_GROUPS = 16 << 20, 1 << 18
#: Parts that the rows of one id pair are spread over where they are joined.
SALTS = 16

_ROWS = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, parts array<int>, times array<int>, part int, key string, freq long, docs long"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_vocabularies() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoders:
    """Both vocabularies: ids of texts, and the bytes of each id.

    A's ids come from merges in the order of their ids where the vocabulary has them so, which gives what the library
    that owns the file gives and is several times faster; else, and for texts that the quick way can't stand, from that
    library itself.
    """

    def __init__(self, a_path: str, b_path: str):
        self.slow = Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True
        spec = json.loads(self.slow.to_str())
        special = {t["id"] for t in spec["added_tokens"]}
        letters, vocab = _byte_letters(), self.slow.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for w, i in vocab.items():
            self.a_bytes[i] = w.encode() if i in special else bytes(letters[c] for c in w)
        joined = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in spec["model"]["merges"]]
        ranks = {self.a_bytes[i]: i for i in vocab.values() if i not in special}
        quick = spec["normalizer"] is None and joined == sorted(set(joined)) and set(ranks.values()) - set(joined) == set(range(256))
        self.quick = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if quick else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]

    def a_ids(self, text: str) -> list[int]:
        if self.quick and len(text) < 1 << 20:
            return self.quick.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def both(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a blank and the text under A and under B; none where the text is empty or a side's bytes differ from it."""
        if not text:
            return [], []
        a, b, want = self.a_ids(f" {text}"), self.b.encode(text, num_threads=1), f" {text}".encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return [], []
        return a, b


@lru_cache(maxsize=2)
def _encoders(a_path: str, b_path: str) -> Encoders:
    return Encoders(a_path, b_path)


def _same_groups(ids: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, code: np.ndarray) -> bool:
    """Whether all groups hold the very ids of the first group of their code."""
    n, want = end - start, (end - start)[first][code]
    return bool((n == want).all()) and bool((ids == ids[np.repeat(start[first][code] - start, n) + np.arange(len(ids))]).all())


class Groups:
    """The groups of many documents: their tokens one after another, cut where tokens of A and of B both end."""

    def __init__(self, pairs: list[tuple[list[int], list[int]]], a_size: np.ndarray, b_size: np.ndarray):
        self.n_a, self.n_b = (np.fromiter((len(p[k]) for p in pairs), np.int64, len(pairs)) for k in (0, 1))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(np.array(p[k], np.int64) for p in pairs if p[k])]) for k in (0, 1))
        a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        ends = np.zeros((a_end[-1] if len(a) else 0) + 1, np.uint8)
        ends[a_end] = 1
        ends[b_end] += 1
        self.a, self.b = a, b
        self.a_to, self.b_to = np.flatnonzero(ends[a_end] == 2) + 1, np.flatnonzero(ends[b_end] == 2) + 1
        self.a_from, self.b_from = np.r_[0, self.a_to[:-1]], np.r_[0, self.b_to[:-1]]
        self.off = np.r_[0, np.searchsorted(self.a_to, np.cumsum(self.n_a), side="right")]

    def coded(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each group, equal for equal ids, and the first group of each number. Hashes tell the groups, and
        their ids are compared with the first one's; should that ever differ, the ids themselves do."""
        if not len(self.a_to):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (span_hashes(mixed(x.astype(np.uint64) + np.uint64(1)), s, e) for x, s, e in ((self.a, self.a_from, self.a_to), (self.b, self.b_from, self.b_to)))
        code, found = pd.factorize(mixed(a ^ mixed(b + np.uint64(1))))
        first = self._first(code, len(found))
        if not (_same_groups(self.a, self.a_from, self.a_to, first, code) and _same_groups(self.b, self.b_from, self.b_to, first, code)):
            code, found = pd.factorize(np.array([self.name(g) for g in range(len(code))], object))
            first = self._first(code, len(found))
        return code, first

    @staticmethod
    def _first(code: np.ndarray, n: int) -> np.ndarray:
        first = np.empty(n, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        return first

    def name(self, g: int) -> str:
        side = lambda x, s, e: ",".join(map(str, x[s:e].tolist()))
        return f"{side(self.a, self.a_from[g], self.a_to[g])}|{side(self.b, self.b_from[g], self.b_to[g])}"


def _interned(paths: tuple[str, str], block_bytes: int):
    kind = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("parts", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("part", pa.int32()), ("key", pa.string()), ("freq", pa.int64()), ("docs", pa.int64())])

    def filled(n: int, **cols: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(n, f.type)) for f in kind], schema=kind)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders(*paths)
        a_size, b_size = (np.array([len(t) for t in x], np.int64) for x in (enc.a_bytes, enc.b_bytes))
        block, seen = TaskContext.get().partitionId() << 32, 0
        known: dict[str, int] = {}
        freq, docs = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

        def dictionary() -> pa.RecordBatch:
            n = len(known)
            return filled(n, block=pa.array(np.full(n, block)), part=pa.array(np.arange(n, dtype=np.int32)), key=pa.array(known, pa.string()), freq=pa.array(freq[:n]), docs=pa.array(docs[:n]))

        for batch in batches:
            texts = batch.column(1).to_pylist()
            g = Groups([enc.both(t) for t in texts], a_size, b_size)
            code, first = g.coded()
            names = [g.name(k) for k in first.tolist()]
            shas = [sha256(";".join(map(names.__getitem__, code[s:e].tolist())).encode()).hexdigest() if e > s else "" for s, e in zip(g.off[:-1].tolist(), g.off[1:].tolist(), strict=True)]
            part = np.fromiter((known.setdefault(w, len(known)) for w in names), np.int64, len(names))
            if len(known) > len(freq):
                freq, docs = (np.r_[x, np.zeros(len(known), np.int64)] for x in (freq, docs))
            doc = np.repeat(np.arange(len(texts)), np.diff(g.off))
            at, pairs = pd.factorize(doc * max(1, len(names)) + code)
            times = np.bincount(at, minlength=len(pairs))
            own, word = np.divmod(pairs, max(1, len(names)))
            np.add.at(freq, part[word], times)
            np.add.at(docs, part[word], 1)
            off = pa.array(np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32))
            lists = lambda x: pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32)))  # noqa: E731, B023
            yield filled(len(texts), block=pa.array(np.full(len(texts), block)), doc_id=batch.column(0), n_a=pa.array(g.n_a), n_b=pa.array(g.n_b), n_groups=pa.array(np.diff(g.off)), groups_sha256=pa.array(shas), parts=lists(part[word]), times=lists(times))
            seen += batch.nbytes
            if seen >= block_bytes or len(known) >= BLOCK_GROUPS:
                yield dictionary()
                block, seen = block + 1, 0
                known.clear()
                freq[:], docs[:] = 0, 0
        yield dictionary()

    return run


def _summed(rows: pa.Table, values: pa.Table) -> pa.Table:
    """The documents of a block, with the values of the block's groups summed up."""
    n = max(values["part"].to_pylist(), default=-1) + 1
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = values["part"].to_numpy()
    count[at], best[at] = values["count"].to_numpy(), values["best"].to_numpy()
    parts, times = (rows[c].combine_chunks() for c in ("parts", "times"))
    word, k, sizes = parts.flatten().to_numpy(), times.flatten().to_numpy(), parts.value_lengths().to_numpy()
    ends = np.cumsum(sizes)
    total = lambda x: (lambda t: t[ends] - t[ends - sizes])(np.r_[0, np.cumsum(x)])
    return pa.table({"doc_id": rows["doc_id"], "n_a": rows["n_a"], "n_b": rows["n_b"], "n_groups": rows["n_groups"], "n_links": rows["n_groups"], "n_best": pa.array(total(k * best[word])), "count_sum": pa.array(total(k * count[word])), "groups_sha256": rows["groups_sha256"]})


def interned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Written once: a row per document with its groups as (part, times) lists, and a row per (block, group) with the
    group's number in the block (part), its ids as text (key), how often it occurs and in how many documents."""
    small_batches(docs)
    return materialised(pick(docs, id_col, text_col).mapInArrow(_interned((a_path, b_path), block_bytes), _ROWS), "aligned")


def link_counts(table: DataFrame, weight: str = "freq") -> tuple[DataFrame, DataFrame]:
    """(groups, links): the group dictionary (key, a, b, freq, docs), and (a, b, count, best) for every linked id pair.

    Within a group only the last tokens end together, as every token has a byte at least: a distinct group is expanded
    to its link once, times its occurrences (weight "freq") or the documents that hold it ("docs")."""
    words = table.where("key IS NOT NULL").groupBy("key").agg(F.sum("freq").alias("freq"), F.sum("docs").alias("docs"))
    last = lambda side: F.substring_index(F.substring_index("key", "|", side), ",", -1).cast("int")
    groups = materialised(words.select("key", last(1).alias("a"), last(-1).alias("b"), "freq", "docs"), "groups")
    counts = groups.groupBy("a", "b").agg(F.sum(weight).alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return groups, materialised(counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "links")


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", weight: str = "freq", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    Texts are tokenised once. What a block of documents repeats is held once in the block's dictionary, what blocks
    repeat once in the corpus's: id pairs are counted over distinct groups, and the counts go back by group to the
    blocks, where each document sums up its own. A task holds a block; a frequent group costs a row a block, and the
    groups of one id pair are dealt over SALTS parts.

    A null or empty text, or one that a side does not give back byte by byte, has zeros and an empty hash. Repeated rows
    and ids are rows of their own and count each; a null id stays null; an empty table gives an empty one. Other columns
    take no part, whatever their names. A long text is tokenised in one piece.
    """
    table = interned(docs, a_path, b_path, id_col, text_col, block_bytes)
    groups, links = link_counts(table, weight)
    spread = links.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = groups.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(spread.hint("merge"), ["a", "b", "salt"]).select("key", "count", F.col("best").cast("long").alias("best"))
    values = table.where("key IS NOT NULL").select("block", "part", "key").join(known.hint("merge"), "key").select(F.col("block").alias("of"), "part", "count", "best")
    rows = table.where("key IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "parts", "times")
    out = rows.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(_summed, _OUT)
    return out.withColumn("doc_id", id_out(F.col("doc_id")))


def op13_group_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_vocabularies())
