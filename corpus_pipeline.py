"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs for the rows
that stay. A row is known by its id and a hash of its text, so rows that repeat an id with another text are judged on
their own, and of rows that repeat both one stays once dedup has run.

In every stage a null text counts as empty, a null id as the largest, and an empty table gives an empty one. Toxicity
scores an empty text like one without any known subsequence and keeps it. Of empty texts one stays after dedup; near dedup
takes texts without words for alike. Decontamination keeps texts without words. Toxicity, decontamination and packing keep
repeated rows as they stand. Columns besides id and text pass through, whatever their names. Needs: labels (doc_id, toxic)
for toxicity, benchmark (item_id, text) for decontamination; without labelled rows nothing is rejected as toxic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbria.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from lumbria.llm.textcols import id_in
from lumbria.session import materialised, ready

#: A document with this score or more is rejected.
TOXIC = 0.3
#: Near copies: words of a shingle and the least Jaccard similarity of a pair.
NEAR_WORDS, LEAST_ALIKE = 5, 0.8
#: SQL has neither the kernel machine nor XXH64; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def _named(docs: DataFrame, **more: Column) -> DataFrame:
    """(row, id, hash, *more): a whole row as one struct, so that no column of docs meets one of a stage's."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(whole, id_in(docs["doc_id"]).alias("id"), F.xxhash64(_text(docs)).alias("hash"), *(c.alias(k) for k, c in more.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under TOXIC, in one pass; the machine is fitted on a bounded sample of labelled rows."""
    ready(spark)
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_of(model, _text(docs)) < TOXIC)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal once A-Z are lower-cased, the row with the smallest id."""
    ready(spark)
    best = exact_dedup.groups(docs, keep="min").where("kept").select(id_in(F.col("doc_id")).alias("id"), F.col("text_sha256").alias("sha"))
    rows = _named(docs, sha=exact_dedup.sha_of(_text(docs)))
    return rows.join(best, ["id", "sha"], "left_semi").dropDuplicates(["id", "sha"]).select("row.*")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that near pairs connect, the row with the smallest id, then hash. Pairs are proposed by
    SimHash fingerprints of their words and shingles and count if they share LEAST_ALIKE of their five-word shingles."""
    ready(spark)
    rows = materialised(simhash.near_prints(docs, words=NEAR_WORDS), "prints")
    near = simhash.near_components(rows)
    # Texts of equal fingerprints are candidates too, whether or not they are linked to others.
    found = rows.join(near, "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("component"))
    same = simhash.verified(docs, materialised(found, "found"), NEAR_WORDS, LEAST_ALIKE)
    best = rows.join(same, "th", "left").groupBy(F.coalesce("class", "th")).agg(F.min(F.struct("doc_id", "th")).alias("b")).select(F.col("b.doc_id").alias("id"), F.col("b.th").alias("hash"))
    return _named(docs).join(best, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"]).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose words benchmark windows cover to less than a twentieth."""
    ready(spark)
    rows = _named(docs).withColumn("key", F.xxhash64("id", "hash"))
    index = decontaminate.build_index(rows.select("key", F.col("row.text").alias("text")), id_col="key")
    found = decontaminate.matches(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = materialised(found.where(decontaminate.contaminated()).select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return rows.join(bad, "key", "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("decontamination", drop_contaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialised(docs, f"stage-{k}")
    return docs
