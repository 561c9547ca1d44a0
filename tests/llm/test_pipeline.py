import collections
import itertools

import xxhash

import corpus_pipeline
from lumbria.llm import simhash
from lumbria.session import materialised

from .cases import docs as odd
from .cases import prose
from .test_corpus import found
from .test_dedup import LOW


def majority(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def shingle_list(t):
    w = t.encode().translate(LOW).split()
    return [b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def near_prints(t):
    """The fingerprints of the set of words, and that of the shingles."""
    h = [xxhash.xxh64(w, seed=42).intdigest() for w in set(t.encode().translate(LOW).split())]
    by_word = [majority([mix(x ^ k * 0x9E3779B97F4A7C15 % 2**64) if k else x for x in h]) for k in range(6)]
    return by_word, majority([xxhash.xxh64(x, seed=42).intdigest() for x in shingle_list(t)])


def like_pairs(rows):
    """Index pairs with a Jaccard similarity of 0.8 or more of their five-word shingles."""
    sets = [set(shingle_list(t)) for _, t in rows]
    by = collections.defaultdict(list)
    for k, x in enumerate(sets):
        for g in x:
            by[g].append(k)
    both = collections.Counter(p for m in by.values() for p in itertools.combinations(m, 2))
    empty = [k for k, x in enumerate(sets) if not x]
    return {p for p, n in both.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)} | set(itertools.pairwise(empty))


def smallest(n, pairs):
    up = list(range(n))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return [root(k) for k in range(n)]


def near_survivors(rows):
    """By brute force what drop_near() keeps of rows in order of their ids."""
    prints = [near_prints(t) for _, t in rows]
    apart = lambda a, b: (a ^ b).bit_count()
    close = lambda a, b: any(apart(x, y) <= 5 for x, y in zip(a[0], b[0], strict=True)) and apart(a[1], b[1]) <= 18
    cls = smallest(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if close(prints[i], prints[j])])
    lab = smallest(len(rows), [(i, j) for i, j in like_pairs(rows) if cls[i] == cls[j]])
    return [r for k, r in enumerate(rows) if lab[k] == k]


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialised(stage(spark, docs, small), f"test-{k}")
        if name == "toxicity":
            left = [tuple(r) for r in out.select("doc_id", "text").collect()]
            assert set(left) <= set(rows) and len(left) > 0.7 * len(rows)
        elif name == "exact dedup":
            best = {}
            for i, t in rows:
                k_ = t.encode().translate(LOW)
                best[k_] = min(best.get(k_, 2**63), i)
            left = [(i, t) for i, t in rows if best[t.encode().translate(LOW)] == i]
        elif name == "near dedup":
            left = near_survivors(sorted(rows))
        elif name == "decontamination":
            hits = {i: (n, len(h)) for (i, n, h, _), _ in found(rows, bench).items()}
            left = [(i, t) for i, t in rows if not (hits[i][1] > 0 and 20 * hits[i][1] >= hits[i][0])]
        else:
            assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, _ in rows}
            break
        assert out.columns == docs.columns
        assert collections.Counter(tuple(r) for r in out.select("doc_id", "text").collect()) == collections.Counter(left)
        docs, rows = out, left


def test_stages_stand_odd_rows(spark, small):
    d = odd(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, d, small)
        assert out.columns == d.columns and 0 < out.count() <= d.count()
        assert stage(spark, d.limit(0), small).count() == 0


def test_columns_pass_through_whatever_their_names(spark, small):
    names = ["row", "id", "hash", "key", "sha", "b", "component", "__row_id", "a.b"]
    rows = [(1, "one text of some words here", *["mine"] * 9), (2, "another text that is unlike it", *["yours"] * 9)]
    d = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, d, small)
        assert out.columns == d.columns and sorted(map(tuple, out.collect())) == rows


def test_near_dedup_judges_rows_on_their_own(spark, small):
    rows = [(None, prose(60, 100 + k)) for k in range(4)] + [(7, prose(60, 200 + k)) for k in range(3)]
    again = [(9, prose(60, 200).upper()), (None, prose(60, 100).upper()), (5, prose(60, 101).upper())]
    out = corpus_pipeline.drop_near(spark, odd(spark, rows + again), small)
    got = collections.Counter((i, t.lower()) for i, t in out.select("doc_id", "text").collect())
    assert got == collections.Counter([rows[0], (5, rows[1][1]), *rows[2:]])


def test_near_dedup_takes_edited_copies_and_verifies(spark, small):
    def edited(k, n):
        w = prose(600, 300 + k).split()
        for i in range(n):
            w[50 + 97 * i] = f"edit{i}"
        return " ".join(w)

    rows = [(1, edited(0, 0)), (2, edited(0, 5)), (3, "the one x"), (4, "the  one x"), (5, edited(1, 0)), (6, " ".join(reversed(edited(1, 0).split())))]
    out = corpus_pipeline.drop_near(spark, odd(spark, rows), small)
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 5, 6]  # the words of 6 are those of 5, its shingles are not


def test_near_dedup_recall(spark):
    """Against every pair at 0.8 or more of the documents of sf0.01, exact copies left out."""
    src = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{src}/documents.parquet").dropDuplicates(["text"])
    rows = sorted((r.doc_id, r.text or "") for r in d.select("doc_id", "text").collect())
    lab = smallest(len(rows), like_pairs(rows))
    want = {rows[k][0] for k in range(len(rows)) if lab[k] != k}
    kept = {r.doc_id for r in corpus_pipeline.drop_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), src).collect()}
    gone = {i for i, _ in rows} - kept
    groups = collections.Counter(lab)
    in_groups = {rows[k][0] for k in range(len(rows)) if groups[lab[k]] > 1}
    assert len(want) >= 5 and len(gone) >= 0.9 * len(want) and gone <= in_groups


def test_word_prints_reach_edited_copies():
    """Of 200 texts with one word in 50 changed and of 200 with a tenth appended, the share that links reach."""
    vocabulary = [f"w{k}" for k in range(4000)]
    import random

    r = random.Random(5)
    text = lambda n: [vocabulary[min(int(r.expovariate(1 / 400)), 3999)] for _ in range(n)]
    close = lambda a, b: any((x ^ y).bit_count() <= simhash.WORD_BITS for x, y in zip(simhash.word_prints(a), simhash.word_prints(b), strict=True))
    edits = more = 0
    for _ in range(200):
        w = text(300)
        e = list(w)
        for k in range(r.randrange(50), 300, 50):
            e[k] = r.choice(vocabulary)
        edits += close(" ".join(w).encode(), " ".join(e).encode())
        more += close(" ".join(w).encode(), " ".join(w + text(30)).encode())
    assert edits >= 0.95 * 200 and more >= 0.9 * 200
    assert not close(" ".join(text(300)).encode(), " ".join(text(300)).encode())


def test_run_applies_all_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    by_stage = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        by_stage = materialised(stage(spark, by_stage, small), "by-stage")
    got = corpus_pipeline.run(spark, small)
    have = collections.Counter(r.doc_id for r in got.where("start = 0").select("doc_id").collect())
    assert have == collections.Counter(r.doc_id for r in by_stage.select("doc_id").collect())
    assert got.where("length > 4096 or offset + length > 4096").count() == 0


def test_verified_is_the_same_in_blocks(spark):
    """One class of chains, groups and lone texts, whole and in blocks of a few texts."""
    import random

    r = random.Random(3)
    rows = []
    for g in range(6):
        w = prose(80, 700 + g).split()
        for _ in range(8):  # each a few words from the one before
            rows.append((len(rows), " ".join(w)))
            w[r.randrange(80)] = f"w{r.random()}"
    d = odd(spark, rows)
    found = d.selectExpr("doc_id", "xxhash64(text) AS th", "1L AS component")
    lab = smallest(len(rows), like_pairs(rows))
    th = {x.doc_id: x.th for x in found.collect()}
    for block in (1 << 20, 4000):
        got = {x.th: x["class"] for x in simhash.verified(d, found, 5, 0.8, block).collect()}
        for i in range(len(rows)):
            for j in range(i):
                assert (got.get(th[i], th[i]) == got.get(th[j], th[j])) == (lab[i] == lab[j])
