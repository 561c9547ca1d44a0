"""Packing by minimum bin slack: a bitset subset-sum picks, for each window, the lengths that fill it closest."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialised
from .slots import with_slots
from .textcols import id_out, pick, small_batches, trimmed

CAPACITY = 4096
END_ID = 2
#: What the quick way below stands in for: a file's normalizer, pre-tokenizer and kind of model.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_CUT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

#: The pre-tokens of lower-case texts within Latin-1, as that pattern has them.
_PARTS = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|[^\\s0-9a-zªµºß-öø-ÿ²³¹¼-¾]+")
_ODD = re.compile("[^\x00-\x1b\x20-\xff]")
#: Stands for the end of a word; texts that hold it are odd.
_END = "\x1c"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """Token ids by a vocabulary file of the tokenizers library.

    Texts within Latin-1 without the special tokens' strings are cut into pre-tokens here: lower-casing and the
    pattern mean the same there, and such texts are in normal form C. Their pre-tokens, each with a byte for its end,
    are merged by tiktoken, where _ranks() tells that this gives the same. All else goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.all = Tokenizer.from_file(path)
        spec = json.loads(self.all.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = self._ranks(spec)
        self.quick = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def _ranks(self, spec: dict) -> dict[bytes, int] | None:
        """The bytes of each id, if merging neighbours by the id of what they give is what the library does.

        It is where merges are in the order of their ids, and each entry, taken as a text, is merged into itself:
        an entry's bytes are then never split into two tokens other than the two of its merge.
        """
        from tokenizers.models import BPE

        model, end = spec["model"], _MODEL["end_of_word_suffix"]
        kind = {k: v for k, v in model.items() if k not in ("vocab", "merges")}
        if (spec["normalizer"], spec["pre_tokenizer"], kind) != (_NORMALIZER, _PRE_TOKENIZER, _MODEL) or any(t["normalized"] for t in spec["added_tokens"]):
            return None
        vocab, letters = model["vocab"], _byte_letters().values()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        joined = [vocab["".join(m)] for m in merges]
        first = {vocab.get(c + e, -1) for c in letters for e in ("", end)}
        if joined != sorted(set(joined)) or first != set(vocab.values()) - set(joined) or len(first) != 512 or max(first) > min(joined):
            return None
        bare = BPE(vocab=vocab, merges=merges)
        for t in vocab:
            if len(self.all.model.tokenize(t.removesuffix(end)) if t.endswith(end) else bare.tokenize(t)) != 1:
                return None
        byte = {c: bytes([b]) for b, c in _byte_letters().items()}
        return {b"".join(map(byte.__getitem__, t.removesuffix(end))) + _END.encode() * t.endswith(end): i for t, i in vocab.items()}

    def ids(self, text: str) -> np.ndarray:
        if self.quick is None or _ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.all.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.quick.encode_ordinary(_END.join([*_PARTS.findall(text.lower()), ""])), np.uint32)


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a worker."""
    return WordTokenizer(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(path: str | None, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path or default_vocabulary())
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(tok.ids(t), np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), capacity):
                    raw = ids[s : s + capacity].tobytes()
                    for c, v in zip(out, (i, s, len(raw) // 4, zlib.crc32(raw), len(ids), raw if with_ids else None), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def fill(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, {length: pieces}) that use up counts, each filling a window as closely as the lengths left can.

    The longest length left opens the window. Over the others, with binary multiples of their counts as items, a bitset
    has a bit for each reachable sum; the highest reachable sum within the room is traced back to counts. A pattern is
    repeated as often as the counts allow. Lengths, not pieces, are what this works on: its cost is bounded by
    capacity, whatever the number of pieces.
    """
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    out = []
    while left:
        top = next(iter(left))
        room = capacity - top
        mask, goal = (1 << (room + 1)) - 1, 1 << room
        reach, layers = 1, []
        for n, c in left.items():
            c, k = min(c - (n == top), room // n), 1
            while c > 0 and not reach & goal:
                take = min(k, c)
                layers.append((n, take, reach))
                reach |= reach << (n * take) & mask
                c, k = c - take, 2 * k
            if reach & goal:
                break
        best, pattern = reach.bit_length() - 1, {top: 1}
        for n, take, before in reversed(layers):
            if not before >> best & 1:
                pattern[n] = pattern.get(n, 0) + take
                best -= n * take
        times = min(left[n] // k for n, k in pattern.items())
        out.append((times, pattern))
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


class _Layout:
    """Where the piece of a length and ordinal goes, by binary search over the patterns' shares of each length."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]):
        used: dict[int, int] = {}
        rows, seq = [], 0
        for times, pattern in plan:
            at = 0
            for n, k in pattern.items():
                rows.append((n, used.get(n, 0), k, seq, at))
                used[n] = used.get(n, 0) + k * times
                at += n * k
            seq += times
        a = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.first, self.each, self.seq, self.at = a.T
        self.key = (self.length << 48) + self.first

    def place(self, length: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.searchsorted(self.key, (length << 48) + ordinal, side="right") - 1
        q = ordinal - self.first[r]
        return self.seq[r] + q // self.each[r], self.at[r] + q % self.each[r] * length


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and offset there.

    A document's ids, end_id last, are cut at multiples of capacity; what is left over is packed by fill() over the
    histogram of lengths (at most capacity numbers reach the driver). Equal lengths are told apart by gapless ordinals,
    found without a task per length. A null text is empty and is one end_id; repeated rows are packed as they stand; an
    empty table gives no piece. with_ids adds ids, little-endian unsigned 32-bit. vocabulary: a file's path that all
    executors have, else the installed public one.
    """
    small_batches(docs)
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    pieces = materialised(pick(docs, id_col, text_col).mapInArrow(trimmed(_pieces(vocabulary, capacity, end_id, with_ids)), kind), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    layout = _Layout(fill(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for n, k in it:
            seq, at = layout.place(n.to_numpy(np.int64), k.to_numpy(np.int64))
            yield pd.DataFrame({"sequence_id": seq, "offset": at})

    out = with_slots(pieces if with_ids else pieces.drop("ids"), "length", ["doc_id", "start", "ids_crc32"], "_k")
    out = out.withColumn("_p", place("length", "_k")).withColumn("doc_id", id_out(F.col("doc_id")))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_p.sequence_id", "_p.offset", *["ids"] * with_ids)


def op8_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
