"""Cross-tokenizer alignment against a plain version of its contract."""

import collections
import hashlib
from bisect import bisect_left, bisect_right
from itertools import pairwise

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from lumbria.llm import alignment

from .cases import ROWS, docs, empty

A, B = alignment.default_vocabularies()


def expected(rows, weight="freq"):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of (doc_id, text) rows."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in enumerate_letters()}
    a_bytes = {i: (w.encode() if w.startswith("<|") and w.endswith("|>") else bytes(letters[c] for c in w)) for w, i in tok.get_vocab().items()}
    b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()))]
    per, count = [], collections.Counter()
    for i, text in rows:
        a = tok.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        if text and not b"".join(a_bytes[x] for x in a) == b"".join(b_bytes[x] for x in b) == f" {text}".encode():
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(a_bytes[x]) for x in a]).tolist(), np.cumsum([len(b_bytes[x]) for x in b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        links = [(a[bisect_left(ends_a, e)], b[bisect_left(ends_b, e)]) for e in common]
        cut = lambda ids, ends: [",".join(map(str, ids[bisect_right(ends, s) : bisect_right(ends, e)])) for s, e in pairwise([0, *common])]
        groups = [f"{x}|{y}" for x, y in zip(cut(a, ends_a), cut(b, ends_b), strict=True)]
        if weight == "freq":
            count.update(links)
        else:
            count.update({g: 1 for g in set(groups)})
        per.append((i, len(a), len(b), links, groups))
    if weight == "docs":
        by = collections.Counter()
        for g, n in count.items():
            by[int(g.split("|")[0].split(",")[-1]), int(g.split("|")[1].split(",")[-1])] += n
        count = by
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(i, n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for i, n_a, n_b, links, groups in per]


def enumerate_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [(b, chr(b)) for b in plain] + [(b, chr(256 + k)) for k, b in enumerate(rest)]


ODD = [*ROWS, (30, "<|endoftext|> and <s> </s> <unk> <0x41> are plain"), (31, "▁ is taken for a blank"), (32, "  two  blanks \n\n\t "), (33, "日本語 😀 ﬁ é \x00 �"), (34, " "), (35, "x" * 3000), (36, "the cat " * 9000)]


@pytest.mark.parametrize("weight", ["freq", "docs"])
@pytest.mark.parametrize("block", [200, 1 << 24])
def test_aligned(spark, weight, block):
    got = alignment.aligned(docs(spark, ODD).repartition(3), A, B, weight=weight, block_bytes=block).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(expected(ODD, weight))
    assert alignment.aligned(empty(spark), A, B).count() == 0


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op13_group_dictionary"](spark, small).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(expected(rows))


def test_groups_by_ids_where_hashes_meet(monkeypatch):
    monkeypatch.setattr(alignment, "span_hashes", lambda values, s, e: np.zeros(len(s), np.uint64))
    g = alignment.Groups([([1, 2, 3], [1, 5]), ([1, 2], [1])], np.array([0, 1, 1, 2]), np.array([0, 2, 0, 0, 0, 2]))
    code, first = g.coded()
    assert [g.name(k) for k in first[code].tolist()] == ["1,2|1", "3|5", "1,2|1"]


def test_slow_way_is_the_same():
    enc = alignment.Encoders(A, B)
    for _, t in ODD:
        assert enc.quick.encode_ordinary(t or "") == enc.slow.encode(t or "", add_special_tokens=False).ids
