import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from lumbria.llm import decontaminate, packing, sharding, toxicity, url_filters, warc
from lumbria.session import scratch

from .cases import ROWS, SHARED, docs, empty, prose

BIG = 2**63 - 1


def test_jump_moves_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(0, 2**63, 20000, dtype=np.uint64)
    for n in (1, 2, 8, 31):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert a.max() == n - 1 and (b[a != b] == n).all()
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.02
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_shards(spark):
    got = sharding.assign(docs(spark)).collect()
    assert len(got) == len(ROWS)
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.assign(empty(spark)).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, offset long")


PAGES = [
    (5, "https://a.example.com/x y\r\nz", "<p>same</p>"), (2, None, "<p>same</p>"), (9, "http://b.example.org/é", "<p>same</p>"), (1, "", None), (7, "u", ""),
    (3, "https://c.example.net", "ñ" * 50_000), (None, "https://d.example.net", "alone"), (11, "https://e.example.net", "alone"), (4, "WARC/1.0", "WARC/1.1\r\n\r\nnested\r\n\r\n"), (4, "WARC/1.0", "WARC/1.1\r\n\r\nnested\r\n\r\n"),
]


@pytest.mark.parametrize("least", [0, 8])
def test_warc_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "READ", 1000)
    folder = scratch(spark, "warc-test")
    index = warc.write_archives(pages(spark, PAGES), folder, least=least)
    rows = index.collect()
    assert len(rows) == len(PAGES) and all(r.length > 0 for r in rows)
    got = warc.read_records(index, folder).collect()
    first = {}
    for i, _, h in PAGES:
        p, i = (h or "").encode(), BIG if i is None else i
        if len(p) >= least:
            first[p] = min(first.get(p, BIG), i)
    want = collections.Counter()
    for i, _, h in PAGES:
        p = (h or "").encode()
        ref = first.get(p)
        revisit = ref is not None and ref != (BIG if i is None else i)
        want[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", ref if revisit else None, None if revisit else p)] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    some = warc.read_records(index.where("page_id in (3, 7)"), folder).collect()
    assert {r.page_id for r in some} == {3, 7}
    none = warc.write_archives(pages(spark, []), folder)
    assert warc.read_records(none, folder).count() == 0


def test_ranges_coalesce():
    got = list(warc.ranges([(0, 10), (10, 5), (40, 5), (500, 10), (505, 20)], gap=30, most=100))
    assert [(a, b) for a, b, _ in got] == [(0, 45), (500, 525)]
    assert [(a, b) for a, b, _ in warc.ranges([(0, 60), (60, 60)], gap=0, most=100)] == [(0, 60), (60, 120)]


RULED = [
    ("https://www.Example.COM/en/7x", "www.example.com", "/en/7x", "example.com/en/7", "allow"), ("http://a.com/en/1?q", "a.com", "/en/1", "com/en/", "block"), ("x://b.net/de/8#f", "b.net", "/de/8", "net/de/", "allow"),
    ("x://q.example.net/de/81", "q.example.net", "/de/81", "example.net/de/8", "block"), ("x://c.org/es/", "c.org", "/es/", "org/es/", "block"), ("x://c.org/es", "c.org", "/es", None, "allow"),
    (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("://", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("x://notcom/en/", "notcom", "/en/", None, "allow"), ("x://ÀB.com?x", "Àb.com", "", None, "allow"),
]


def test_url_rules(spark):
    p = spark.createDataFrame([(k, r[0], "h") for k, r in enumerate(RULED)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "id long, good int")
    got = {r.page_id: r for r in url_filters.judge(p, none).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(RULED):
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict), RULED[k]
    assert url_filters.judge(p.limit(0), none).count() == 0


def test_url_templates_reject_impure_branches(spark):
    rows, labels = [], []
    for k in range(300):
        rows.append((k, f"https://h.test/{'spam' if k % 3 == 0 else ('news' if k % 3 == 1 else 'blog')}/{k}"))
        if k % 2 == 0:
            labels.append((k, 0 if k % 3 == 0 else 1))
    p = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filters.judge(p, spark.createDataFrame(labels, "id long, good int"), rules=()).collect()
    assert {r.template for r in got} == {"/spam/*", "/*1/*"}
    assert all((r.verdict == "block") == ("spam" in r.path) for r in got)
    plan = url_filters.judge(p, spark.createDataFrame(labels, "id long, good int"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def tree_expected(urls, t):
    """Templates, purity and verdict by the rules of Tree, over all urls at once."""
    rows = [[k, host, [x for x in path.split("/") if x], good, ""] for k, host, path, good in urls]
    for d in range(max(len(r[2]) for r in rows)):
        counts = collections.defaultdict(lambda: [0, 0])
        for _, host, segs, good, tmpl in rows:
            if len(segs) > d and good is not None:
                for key in ((host, tmpl), (host, tmpl, segs[d])):
                    counts[key][0] += 1
                    counts[key][1] += good
        band, special = {}, collections.defaultdict(dict)
        for host, tmpl, seg in {(r[1], r[4], r[2][d]) for r in rows if len(r[2]) > d}:
            (lab, fine), (l, f) = counts[host, tmpl, seg], counts[host, tmpl]
            if lab >= t.labels and l > lab:
                p = (f + 1) / (l + 2)
                if abs(fine / lab - (f - fine) / (l - lab)) > t.z * (p * (1 - p) * (1 / lab + 1 / (l - lab))) ** 0.5:
                    special[host, tmpl][seg] = (fine / lab, lab, fine)
        for (host, tmpl), kinds in special.items():
            alike, last = 0, None
            for share, lab, fine in sorted(set(kinds.values())):
                if last:
                    p = (fine + last[2] + 1) / (lab + last[1] + 2)
                    alike += abs(share - last[0]) > t.z * (p * (1 - p) * (1 / lab + 1 / last[1])) ** 0.5
                last = (share, lab, fine)
                band |= {(host, tmpl, seg): alike for seg, v in kinds.items() if v == last}
        alike = collections.Counter((host, tmpl, b) for (host, tmpl, _), b in band.items())
        for r in rows:
            if len(r[2]) > d:
                b = band.get((r[1], r[4], r[2][d]))
                r[4] += "/" + ("*" if b is None else f"*{b}" if alike[r[1], r[4], b] > 1 else r[2][d])
    n = collections.defaultdict(lambda: [0, 0])
    for _, host, _, good, tmpl in rows:
        for key in ((host, tmpl), (host,), ()):
            n[key][0] += good is not None
            n[key][1] += good or 0
    prior = min((n[()][1] + 1) / (n[()][0] + 1), 1.0)
    out = {}
    for k, host, _, _, tmpl in rows:
        hp = (n[(host,)][1] + t.weight * prior) / (n[(host,)][0] + t.weight)
        purity = (n[host, tmpl][1] + t.weight * hp) / (n[host, tmpl][0] + t.weight)
        out[k] = (tmpl, round(purity, 9), n[host, tmpl][0], "block" if purity < t.least else "allow")
    return out


@pytest.mark.parametrize("size", [8 << 20, -1])
def test_url_tree_against_brute_force(spark, size, monkeypatch):
    import random

    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", size)
    r, urls = random.Random(8), []
    for k in range(3000):
        host = r.choice(["a.test"] * 6 + ["b.test", "c.test"])  # a host with most of all urls
        kind = r.choice(["news", "blog", "shop", "spam", "scam", "u"])
        path = "/" + "/".join([kind, *([str(k)] if r.random() < 0.7 else ["casino" if r.random() < 0.3 else "x"]), *(["p"] * r.randrange(14) if r.random() < 0.1 else [])])
        bad = kind in ("spam", "scam") or "casino" in path
        urls.append((k, host, path, None if r.random() < 0.4 else int(r.random() > (0.9 if bad else 0.1))))
    urls += [(3000, "", "", None), (3001, "a.test", "", 1), (3002, "a.test", "//", 0)]
    want = tree_expected(urls, url_filters.Tree())
    p = spark.createDataFrame([(k, f"x://{h}{path}" if h else None, "t") for k, h, path, _ in urls], "page_id long, url string, template string")
    lab = spark.createDataFrame([(k, g) for k, _, _, g in urls if g is not None], "id long, good int")
    got = url_filters.judge(p, lab, rules=()).collect()
    assert len(got) == len(urls) and {x.page_id: (x.template, round(x.purity, 9), x.n_labelled, x.verdict) for x in got} == want
    assert {"/*0/*", "/*1/*"} & {w[0] for w in want.values()} and {v[3] for v in want.values()} == {"allow", "block"}


def test_url_templates_of_any_depth(spark):
    """What stands apart below a long common way is found, and a path of 3,000 segments takes no 3,000 rounds."""
    way = "/".join("abcdefghijkl")
    urls = [(k, f"x://h.test/{way}/{'bad' if k % 2 else 'good'}/{k}") for k in range(60)] + [(60, "x://h.test" + "/q" * 3000)]
    p, lab = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "id long, good int")
    got = {r.page_id: (r.template, r.verdict) for r in url_filters.judge(p, lab, rules=()).collect()}
    assert {got[k] for k in range(60)} == {("/*" * 12 + "/bad/*", "block"), ("/*" * 12 + "/good/*", "allow")}
    assert got[60] == ("/*" * 3000, "allow")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def found(rows, items):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[k : k + 13])].add(i)
    out = collections.Counter()
    for i, t in rows:
        w, hit, its = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    its |= wins[tuple(w[k : k + n])]
        out[(i, len(w), tuple(sorted(hit)), tuple(sorted(its)))] += 1
    return out


ITEMS = [(1, " ".join(SHARED.split()[10:40])), (2, "Hello, WORLD"), (3, None), (4, "..."), (5, prose(20, 99)), (6, "日本語"), (7, " ".join(prose(4000, 5).split()[3000:3014])), (7, "x")]


@pytest.mark.parametrize("block", [8 << 20, 150])
def test_decontamination(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 3000)
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, doc_id long")
    got = decontaminate.matches(decontaminate.build_index(docs(spark)), items).collect()
    assert collections.Counter((r.doc_id, r.n_words, tuple(sorted(r.hit_words)), tuple(sorted(r["items"]))) for r in got) == found(ROWS, ITEMS)
    assert decontaminate.matches(decontaminate.build_index(empty(spark)), items).count() == 0
    assert all(not r.hit_words for r in decontaminate.matches(decontaminate.build_index(docs(spark)), items.limit(0)).collect())


def thue_morse(n):
    """Two words of 2**n letters, each the other's complement, that have one hash where that is a polynomial modulo 2**64."""
    return ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(2**n)) for flip in (0, 1)]


def test_words_of_one_hash_are_told_apart(spark):
    one, other = thue_morse(10)
    rows = [(1, f"{one} x"), (2, f"{other} y {other}"), (3, f"{other} {one} {other}")]
    items = [(7, one), (8, f"{other} y"), (9, f"{one} {other}")]
    d = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").coalesce(1)
    got = decontaminate.matches(decontaminate.build_index(d), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.n_words, tuple(sorted(r.hit_words)), tuple(sorted(r["items"]))) for r in got) == found(rows, items)


def test_proximity(spark):
    d = docs(spark, [(1, "alpha one beta gamma"), (2, "alpha beta gamma"), (3, "gamma far away from all alpha beta")])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    index = decontaminate.build_index(d)
    assert {r.doc_id for r in decontaminate.matches(index, items).collect() if r.hit_words} == {2}
    assert {r.doc_id for r in decontaminate.matches(index, items, slop=1).collect() if r.hit_words} == {1, 2}


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    rows = [*ROWS, (30, "It's we'll DON'T 'tis Straße º² 12.5 !!! ..., <|endoftext|> x"), (31, "café cafe\u0301 Σίσυφος İstanbul\x85\xa0\x1cq")]
    got = packing.pack(docs(spark, rows), capacity=capacity, with_ids=True).collect()
    have = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * capacity
        have[(r.doc_id, r.doc_tokens)].append(r)
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        own = {r.start: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in have[(i, len(ids))] if np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[r.start : r.start + r.length]}
        assert sorted(own) == list(range(0, len(ids), capacity))
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    total = 0
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += at
    assert len(seqs) - total / capacity < 1 + 0.05 * len(seqs)
    assert packing.pack(empty(spark)).count() == 0


def test_word_ids_are_the_librarys_and_quick():
    """Ids of every entry and of random Latin-1 texts against the library; words never seen take less of its time."""
    import random
    import time

    tok = packing.tokenizer(packing.default_vocabulary())
    assert tok is packing.tokenizer(packing.default_vocabulary()) and tok.quick

    def library(text):
        return tok.all.encode(text, add_special_tokens=False).ids

    entries = " ".join(t.replace("</w>", " ") for t in tok.all.get_vocab() if "|" not in t)
    r, letters = random.Random(8), [*map(chr, range(256)), *"''''   aeinst", "'ll", "</w>", "<|endoftext|>", "é", "́"]
    mixed = ["".join(r.choices(letters, k=k % 300)) for k in range(3000)]
    single = ["a" * 5000, "-=" * 3000, "".join(r.choices("etaoinshrdlé", k=20_000))]
    for text in [entries, *mixed, *single]:
        assert tok.ids(text).tolist() == library(text)
    new = [" ".join("".join(r.choices("etaoinshrdlucmé", k=9)) for _ in range(500)) for _ in range(60)]
    times = []
    for f in (tok.ids, library):
        at = time.process_time()
        for text in new:
            f(text)
        times.append(time.process_time() - at)
    assert times[0] < 0.6 * times[1]


def test_other_vocabularies_go_to_the_library(tmp_path):
    """A file of another pattern, one whose merges are not in the order of their ids, one with an entry never merged."""
    import json

    with open(packing.default_vocabulary()) as f:
        whole = f.read()
    for k in range(3):
        spec = json.loads(whole)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        if k == 2:
            splits = ((i, [t[:n], t[n:]]) for i, (a, b) in enumerate(merges) for t in [a + b] for n in range(1, len(t)) if n != len(a) and t[:n] in vocab and t[n:] in vocab)
            at, other = next(splits)
            merges[at] = other
        elif k:
            merges[:2] = merges[1::-1]
        else:
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
        (tmp_path / f"{k}.json").write_text(json.dumps(spec))
        tok = packing.WordTokenizer(str(tmp_path / f"{k}.json"))
        text = "it's 2024b, the thin inthan"
        assert tok.quick is None and tok.ids(text).tolist() == tok.all.encode(text, add_special_tokens=False).ids


def test_fill_is_as_close_as_can_be():
    """The first window of random multisets against all their subsets."""
    import itertools
    import random

    r = random.Random(9)
    for _ in range(60):
        sizes = [r.randrange(1, 60) for _ in range(9)]
        best = max(sum(c) + max(sizes) for n in range(9) for c in itertools.combinations(sorted(sizes)[:-1], n) if sum(c) + max(sizes) <= 64)
        _, pattern = packing.fill(collections.Counter(sizes), 64)[0]
        assert max(sizes) in pattern and sum(n * k for n, k in pattern.items()) == best


def test_fill_uses_everything():
    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = dict(collections.Counter(rng.integers(1, 4097, 300).tolist()))
        used = collections.Counter()
        for times, pattern in packing.fill(counts):
            assert sum(n * k for n, k in pattern.items()) <= 4096
            for n, k in pattern.items():
                used[n] += k * times
        assert used == counts
    assert packing.fill({4096: 10**12, 1: 10**15})[0] == (10**12, {4096: 1})


def test_squeezed():
    texts = [b"so a i.d.i.o.t is", b"x", b"", b"a b\nc d", b"U S A, a bc d e", "é i d i o t".encode(), b"a.b", b"1 2 3 a1b2c3"]
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    data, at, where = toxicity.squeezed(np.frombuffer(b"".join(texts), np.uint8), off)
    got = [data[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
    assert got == [b"so aidiot is", b"x", b"", b"a b\nc d", b"USAa bc d e", "é idiot".encode(), b"a.b", b"1 2 3 abc3"]
    assert (np.frombuffer(b"".join(texts), np.uint8)[where] == data).all()


def test_kernel_features_and_landmarks():
    """window_scores() against the kernel as it is defined; half() of landmarks gives back the kernel among them."""
    from itertools import combinations

    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 103, 60).astype(np.uint8))
    weights = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    low, at = toxicity.padded([text])
    got = toxicity.window_scores(low, weights)
    t = toxicity._TABS
    for s in range(len(text)):
        want = 0.0
        for i in range(s, s + toxicity.WINDOW):
            for c in combinations(range(1, toxicity.SPAN), 3):
                four = [low[i], *(low[i + k] for k in c)]
                want += toxicity.DECAY ** (c[2] - 3) * weights[t[0][four[0]] ^ t[1][four[1]] ^ t[2][four[2]] ^ t[3][four[3]]]
        assert abs(got[s] - want) < 1e-3
    x, w = toxicity._features(low, np.arange(0, 40, 4))
    known, inv = np.unique(x, return_inverse=True)
    z = np.zeros((len(known), len(x)), np.float32)
    np.add.at(z, (inv.reshape(x.shape), np.arange(len(x))[:, None]), np.broadcast_to(w, x.shape))
    counts = [collections.Counter() for _ in x]
    for c, row in zip(counts, x, strict=True):
        for code, weight in zip(row, w[0], strict=True):
            c[code] += float(weight)
    dot = np.array([[sum(v * b[k] for k, v in a.items()) for b in counts] for a in counts])
    assert np.allclose(z.T @ z, dot, rtol=1e-4) and np.allclose(toxicity._gram(x, w, known, z), dot, rtol=1e-4)


def test_toxicity(spark):
    rows = [(k, prose(60, k) + ("" if k % 4 else " you stupid idiot there ") + prose(30, k + 1000)) for k in range(400)] + [(1003, None), (1004, ""), (1005, "\n\n")]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(None, 1, 1), (999999, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(d, labels)
    got = toxicity.scores(d, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    best = lambda t: model.score(np.maximum(toxicity._best(*toxicity.laid([t]), model.weights)[1], 0).astype(float))[0]
    assert best(b"such a stupid id-iot") > 0.5 > best(b"such a lovely day")
    clean = [prose(40, 5000 + k).encode() for k in range(100)]
    for spelt in (lambda w: ".".join(w), lambda w: " ".join(w), lambda w: "-".join(w), lambda w: w[:2] + w[1:], lambda w: w[:3] + "*" + w[3:]):
        texts = [c + f" you {spelt(('stupid', 'idiot')[k % 2])} {spelt('stupid')} {spelt('idiot')} there".encode() for k, c in enumerate(clean)]
        assert sum(best(t) >= 0.3 for t in texts) >= 90
    assert sum(best(c + b" by J. R. R. T. and a b c d e f of it") >= 0.3 for c in clean) <= 2
    assert toxicity.scores(empty(spark), model).count() == 0
    alone = toxicity.fitted(d, labels.where("toxic = 0"))
    assert all(r.score < 0.3 for r in toxicity.scores(d, alone).collect())
    for few in (labels.limit(0), labels.where("toxic = 1")):
        assert all(r.score < 1e-9 for r in toxicity.scores(d, toxicity.fitted(d, few)).collect())
    by_column = {r.doc_id: r.s for r in d.select("doc_id", toxicity.score_of(model, d["text"]).alias("s")).where("text is not null").collect()}
    assert all(abs(by_column[r.doc_id] - r.score) < 1e-6 for r in got if r.doc_id in by_column)
