"""The queries as they are registered, over whole tables of the smallest size."""

import collections
import hashlib
import struct
import zlib

import duckdb
import pytest
import xxhash

import __spark_entry__ as entry
from lumbria.llm import packing

from .test_dedup import components, fingerprint, repeats_expected


@pytest.fixture(scope="module")
def texts(spark, small):
    return [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, small, name):
    return entry.queries()[name](spark, small).collect()


@pytest.mark.parametrize("name", ["op1_warc_index", "op6_line_store", "op7_phrase_index", "op10_content_sort"])
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = entry.queries()[name](spark, small).select(*names).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want.fetchall())


def test_op2(spark, small):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = rows(spark, small, "op2_template_tree")
    assert {r.page_id for r in got} == set(pages)
    actions = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    for r in got:
        url = pages[r.page_id] or ""
        head, mark, rest = url.partition("://")
        host = rest.split("/")[0].split("?")[0].split("#")[0] if mark else ""
        path = rest[len(host) :].split("?")[0].split("#")[0]
        low = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [k for k in actions if (low == k.split("/")[0] or low.endswith("." + k.split("/")[0])) and path.startswith("/" + k.partition("/")[2])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (low, path, rule) and r.verdict in ("allow", "block") and (rule is None or r.verdict == actions[rule])


def test_op3(spark, small, texts):
    want = [(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in repeats_expected(texts, 200)]
    assert sorted(map(tuple, rows(spark, small, "op3_two_stage_suffixes"))) == want


def jump(key, shards):
    """Lamping and Veach's loop."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_op4(spark, small, texts):
    got = rows(spark, small, "op4_jump_shards")
    key = lambda i: xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == collections.Counter((i, len(t) + 1, zlib.crc32(t), "key", jump(key(i), 8), jump(key(i), 9)) for i, t in texts)
    for s in range(8):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_op5(spark, small, texts):
    nodes = [(i, fingerprint(t)) for i, t in texts]
    want = components(nodes, 2)
    assert {tuple(r) for r in rows(spark, small, "op5_simhash_pivots")} == {(i, f"{f:016x}", want[i, f]) for i, f in nodes}


def test_op8(spark, small, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    ids = {i: [*tok.encode(t.decode(), add_special_tokens=False).ids, 2] for i, t in texts}
    got = rows(spark, small, "op8_bin_slack")
    have = collections.defaultdict(list)
    seqs = collections.defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *part))
        have[r.doc_id] += range(r.start, r.start + r.length)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(have[i]) == list(range(len(x))) for i, x in ids.items())
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(map(len, ids.values()))
    assert len(seqs) <= 1.02 * total / 4096 + 1


def test_op9(spark, small, texts):
    got = {r.doc_id: r for r in rows(spark, small, "op9_string_kernel")}
    assert set(got) == {i for i, _ in texts}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    larger = [r for r in entry.queries()["op9_string_kernel"](spark, "/root/testdata/sf0.01").collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(r.predicted for r in larger if labels[r.doc_id] == 0) <= 0.05 * len(larger)
