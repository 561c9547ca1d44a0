"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel counts common subsequences of four bytes, gaps allowed, each occurrence weighted by DECAY for every byte of
its span beyond four, so a word keeps most of its features when a character is inserted (id*iot) or doubled, and about
half when a letter is changed. Letters that are spelt one by one (i.d.i.o.t, i d i o t) are first taken together. A
sentence is judged by its best window of WINDOW starts, a text by its best sentence. README gives measured shares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcols import blocks, flat, give_back, id_out, lowered, pick, small_batches, trimmed

SPAN, DECAY, WINDOW = 7, 0.7, 8
#: Subsequences are told apart by this many bits of a tabulation hash.
BITS = 18
#: Bound of the fit: so many labelled rows of each kind, of texts of at most so many bytes, by the order of a hash.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 1200, 2400, 16_000
LANDMARKS, ROUNDS, COST = 128, 4, 10.0
#: Share of a true sentence's cost that a misspelt word has.
ODD = 0.05

_TABS = np.random.default_rng(31).integers(0, 1 << BITS, (4, 256), dtype=np.uint32)
_GAPS = [(c, np.float32(DECAY ** (c[2] - 3))) for c in combinations(range(1, SPAN), 3)]
_PAD = SPAN + 1
_ENDS = re.compile(rb"[.!?\n]+")


def codes(low: np.ndarray) -> list[np.ndarray]:
    """For each gap pattern, the hashed subsequence that begins at each of the first len(low) - SPAN + 1 bytes."""
    n = len(low) - SPAN + 1
    t = [_TABS[k][low] for k in range(4)]
    return [t[0][:n] ^ t[1][a : a + n] ^ t[2][b : b + n] ^ t[3][c : c + n] for (a, b, c), _ in _GAPS]


def padded(texts: list[bytes] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts lower-cased, one after another, each followed by zero bytes: no subsequence reaches another text's bytes."""
    data, off = texts if isinstance(texts, tuple) else (np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)])
    size = np.diff(off)
    at = np.r_[0, np.cumsum(size + _PAD + WINDOW)]
    out = np.zeros(at[-1] + SPAN, np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - off[:-1], size)] = lowered(data)
    return out, at


#: A letter, as far as single ones are concerned: a-z and every byte of a longer code point.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True


def squeezed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts without what stands between letters that are spelt one by one, their offsets, and where each byte was.

    Three single letters or more with one or two other bytes between, but no line end, are taken for one word: a gap
    between all of its letters would otherwise carry a word beyond the kernel's span.
    """
    letter = _LETTER[data]
    start = np.zeros(len(data) + 1, bool)
    start[off] = True
    before = np.r_[False, letter[:-1]] & ~start[:-1] if len(data) else letter
    after = np.r_[letter[1:], False] & ~start[1:] if len(data) else letter
    p = np.flatnonzero(letter & ~before & ~after)
    keep = np.ones(len(data), bool)
    if len(p) > 2:
        gap, text = np.diff(p), np.searchsorted(off, p, side="right")
        near = (gap <= 3) & (text[1:] == text[:-1]) & (data[p[:-1] + 1] != 10) & (data[p[1:] - 1] != 10)
        near &= np.r_[near[1:], False] | np.r_[False, near[:-1]]
        a, g = p[:-1][near], gap[near]
        keep[a + 1] = False
        keep[a[g == 3] + 2] = False
    at = np.flatnonzero(keep)
    return data[at], np.searchsorted(at, off), at


def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """padded() of squeezed() texts."""
    data, off, _ = squeezed(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return padded((data, off))


def window_scores(low: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Decision value, less the bias, of the window at each byte."""
    n = max(0, len(low) - SPAN + 1)
    s = np.zeros(n + WINDOW, np.float32)
    if n:
        t = [_TABS[k][low] for k in range(4)]
        for (a, b, c), w in _GAPS:
            s[:n] += w * weights[t[0][:n] ^ t[1][a : a + n] ^ t[2][b : b + n] ^ t[3][c : c + n]]
    k = 1
    while k < WINDOW:
        s = s[:-k] + s[k:]
        k *= 2
    return s[:n]


@dataclass
class Model:
    """weights: of every hashed subsequence, the landmarks' expansion summed up. A text scores
    1 / (1 + exp(-(slope * best window + shift)))."""

    weights: np.ndarray
    slope: float
    shift: float

    def score(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.maximum(best, -50) + self.shift, -30, 30)))


def _features(low: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights, (windows, WINDOW * patterns), of the windows that begin at starts."""
    at = (starts[:, None] + np.arange(WINDOW)).clip(0, len(low) - SPAN)
    cols = [_TABS[0][low[at]] ^ _TABS[1][low[at + a]] ^ _TABS[2][low[at + b]] ^ _TABS[3][low[at + c]] for (a, b, c), _ in _GAPS]
    w = np.concatenate([np.full((1, WINDOW), w, np.float32) for _, w in _GAPS], axis=1)
    return np.concatenate(cols, axis=1), w


def _gram(x: np.ndarray, w: np.ndarray, known: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Kernel values of windows x against landmarks, z[k] being the landmarks' features of code known[k]."""
    out = np.zeros((len(x), z.shape[1]), np.float32)
    for s in range(0, len(x), 256):
        part = x[s : s + 256]
        at = np.searchsorted(known, part).clip(0, len(known) - 1)
        out[s : s + 256] = np.einsum("ij,ijk->ik", w * (known[at] == part), z[at], optimize=True)
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Primal squared-hinge machine by Newton steps over the rows within the margin."""
    a = np.c_[x, np.ones(len(x))].astype(np.float64)
    w = np.zeros(a.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        inside = y * (a @ w) < 1
        m = a[inside] * cost[inside][:, None]
        new = np.linalg.solve(ridge + m.T @ a[inside], m.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _sentences(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Sentences of all texts, and of each the number of its text."""
    out, of = [], []
    for k, t in enumerate(texts):
        for s in _ENDS.split(t):
            if len(s) >= 4:
                out.append(s)
                of.append(k)
    return out, np.array(of, np.int64)


def _best(low: np.ndarray, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the start and the value of its best window; windows begin within the text, not behind it."""
    first, best = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.float32)
    for i, j in blocks(at):
        s = window_scores(low[at[i] : at[j] + SPAN - 1], weights)
        size = np.diff(at[i : j + 1])
        of = np.repeat(np.arange(j - i, dtype=np.int32), size)
        begin = at[i:j] - at[i]
        behind = np.arange(len(s), dtype=np.int32) - begin[of].astype(np.int32) >= (size - _PAD - WINDOW)[of]
        s[behind] = -np.inf
        top = np.maximum.reduceat(s, begin)
        hit = np.flatnonzero(s == top[of])
        own = begin.copy()
        own[of[hit][::-1]] = hit[::-1]
        first[i:j], best[i:j] = own + at[i], top
    return first, best


def _spelt(low: np.ndarray, starts: np.ndarray, rng: np.random.Generator) -> list[bytes]:
    """The words at or after starts with something between their letters, or a letter twice, or one letter changed."""
    out = []
    for s in starts:
        m = re.search(rb"[^\x00-\x20.,;:!?]{4,}", low[s : s + WINDOW + SPAN + 6].tobytes())
        if not m:
            continue
        w = m[0]
        gap = rng.choice([b".", b"-", b"*", b" ", b"_"])
        k = int(rng.integers(1, len(w)))
        out.append([gap.join(w[i : i + 1] for i in range(len(w))), w[:k] + gap + w[k:], w[:k] + w[k - 1 : k] + w[k:], w[:k] + gap + w[k + 1 :]][int(rng.integers(4))])
    return out


def fit(toxic: list[bytes], clean: list[bytes], seed: int = 3) -> Model:
    """Learns from labelled texts, in rounds over their sentences.

    At first, contiguous subsequences are weighted by how much more often toxic texts hold them. In each round, the best
    sentence of a toxic text is its toxic one, if it stands out from nearly all clean texts' best ones, all sentences of clean texts are clean, of which the best of each text
    and a random few are taken; some words of both are misspelt, so that a gap alone says nothing; landmarks are drawn from both kinds; the machine's solution over Nyström features is
    folded into a weight per subsequence. At last a logistic curve is fitted to the texts' values. Without texts of both
    kinds nothing can be told apart, and every text scores 0.
    """
    rng = np.random.default_rng(seed)
    if not toxic or not clean:
        return Model(np.zeros(1 << BITS, np.float32), 1.0, -30.0)
    texts = [*toxic, *clean]
    sents, of = _sentences(texts)
    low, at = laid(sents)
    weights = _odds(toxic, clean)
    is_toxic = np.arange(len(texts)) < len(toxic)
    for _ in range(ROUNDS):
        start, top = _best(low, at, weights)
        order = np.lexsort((-top, of))
        best = order[np.r_[True, of[order][1:] != of[order][:-1]]]
        pos = best[is_toxic[of[best]]]
        hard = best[~is_toxic[of[best]]]
        pos = pos[top[pos] > np.quantile(top[hard], 0.98)] if len(hard) else pos
        if not len(pos):
            break
        rest = np.flatnonzero(~is_toxic[of])
        neg = np.union1d(hard, rng.choice(rest, min(len(rest), 4000), replace=False))
        pos_at = start[pos]
        neg_at = start[neg] + np.where(rng.random(len(neg)) < 0.5, 0, rng.integers(0, 40, len(neg)))
        neg_at = np.minimum(np.where(np.isin(neg, hard), start[neg], neg_at), at[neg + 1] - 1)
        marks = np.r_[rng.choice(pos_at, min(len(pos_at), LANDMARKS * 3 // 4), replace=False), rng.choice(neg_at, min(len(neg_at), LANDMARKS // 4), replace=False)]
        zx, w = _features(low, marks)
        known, inv = np.unique(zx, return_inverse=True)
        z = np.zeros((len(known), len(marks)), np.float32)
        np.add.at(z, (inv.reshape(zx.shape), np.arange(len(marks))[:, None]), np.broadcast_to(w, zx.shape))
        z /= np.sqrt((z * z).sum(0)) + 1e-6
        val, vec = np.linalg.eigh((z.T @ z).astype(np.float64))
        half = vec / np.sqrt(np.maximum(val, 1e-3)) @ vec.T
        new_pos, new_neg = _spelt(low, rng.choice(pos_at, min(len(pos_at), 600), replace=False), rng), _spelt(low, rng.choice(neg_at, min(len(neg_at), 1800), replace=False), rng)
        odd, ends = laid([*new_pos, *new_neg])
        x = np.concatenate([_features(low, np.r_[pos_at, neg_at])[0], _features(odd, ends[:-1])[0]])
        k = _gram(x, w, known, z) @ half
        y = np.r_[np.ones(len(pos_at)), -np.ones(len(neg_at)), np.ones(len(new_pos)), -np.ones(len(new_neg))]
        trust = np.where(np.arange(len(y)) < len(pos_at) + len(neg_at), 1.0, ODD)
        beta, _ = _svm(k, y, COST * 100 * trust / np.where(y > 0, np.sum(trust[y > 0]), np.sum(trust[y < 0])))
        weights = np.zeros(1 << BITS, np.float32)
        weights[known] = z @ (half @ beta)
    whole, ends = laid(texts)
    _, top = _best(whole, ends, weights)
    return Model(weights, *_curve(np.maximum(top, 0), is_toxic))


def _odds(toxic: list[bytes], clean: list[bytes]) -> np.ndarray:
    counts = []
    for kind in (toxic, clean):
        n = np.zeros(1 << BITS)
        for t in kind:
            low = lowered(np.frombuffer(t, np.uint8))
            if len(low) >= 4:
                m = len(low) - 3
                n[np.unique(_TABS[0][low[:m]] ^ _TABS[1][low[1 : m + 1]] ^ _TABS[2][low[2 : m + 2]] ^ _TABS[3][low[3 : m + 3]])] += 1
        counts.append(n)
    a, b = counts
    lift = np.log((a + 0.5) / (len(toxic) + 1)) - np.log((b + 0.5) / (len(clean) + 1))
    return np.where((a >= 3) & (lift > 2.6), lift * np.sqrt(a / len(toxic)), 0).astype(np.float32)


def _curve(top: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic curve with a light ridge, by Newton steps."""
    a, y, w = np.c_[top, np.ones(len(top))].astype(np.float64), toxic.astype(float), np.zeros(2)
    scale = a[:, 0].std() + 1e-9
    a[:, 0] /= scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])


def held_out(doc_id: Column) -> Column:
    """Rows that the fit must not see."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most MOST_TOXIC and MOST_CLEAN labelled rows that held_out() leaves, of at most MOST_BYTES each."""
    small_batches(docs)
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_t")).where("_id is not null and _t is not null").groupBy("_id").agg(F.max("_t").alias("_t")).where(~held_out(F.col("_id")))
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).where(F.octet_length("text").between(1, MOST_BYTES))
    kinds = []
    for toxic, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        some = lab.where(F.col("_t") == toxic).orderBy(F.xxhash64("_id"), "_id").limit(4 * most)
        rows = d.join(F.broadcast(some), F.col("doc_id") == F.col("_id"), "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(most)
        kinds.append([r["text"].encode() for r in rows.select("text").collect()])
    model = fit(*kinds)
    give_back()
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(1))
            out, where = [np.zeros(0)], [np.zeros(0, np.int64)]
            for i, j in blocks(off, 1 << 19):
                own = off[i : j + 1] - off[i]
                d, o, was = squeezed(data[off[i] : off[j]], own)
                low, at = padded((d, o))
                start, top = _best(low, at, model.weights)
                out.append(model.score(np.maximum(top, 0).astype(np.float64)))
                where.append(np.r_[was, len(data)][np.minimum(start - at[:-1] + o[:-1], len(was))] - own[:-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out)), pa.array(np.concatenate(where))], names=["doc_id", "score", "best_at"])

    return run


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1) and best_at, the byte where the best window begins. Whole texts are scored, in one
    pass without a shuffle; null and empty texts have the score of a text without any known subsequence."""
    small_batches(docs)
    return pick(docs, id_col, text_col).mapInArrow(trimmed(_scored(model)), "doc_id long, score double, best_at long").withColumn("doc_id", id_out(F.col("doc_id")))


def score_of(model: Model, text: Column) -> Column:
    """The score as a column, for a filter that leaves all other columns where they are. Call fitted() or small_batches()
    before: Arrow batches should be bounded."""

    @F.pandas_udf("double")
    def score(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in it:
                raw, out = [t.encode() for t in texts], [np.zeros(0)]
                for i, j in blocks(np.r_[0, np.cumsum([len(r) for r in raw], dtype=np.int64)], 1 << 19):
                    low, at = laid(raw[i:j])
                    out.append(model.score(np.maximum(_best(low, at, model.weights)[1], 0).astype(np.float64)))
                yield pd.Series(np.concatenate(out))
        finally:
            give_back()

    return score(text)


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scores(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
