"""Exact dedup by content sort: sampled splitters, external sort, neighbouring full comparisons."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialised
from .textcols import ASCII_LOWER, give_back, id_out, pick, small_batches, trimmed

#: Bytes of the normalised text that lead the sort key. The digest follows, so the key is bounded however long texts are.
LEAD = 64


@F.pandas_udf(T.StructType([T.StructField("lead", T.BinaryType()), T.StructField("sha", T.BinaryType())]))
def _key(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    try:
        for texts in it:
            lead, sha = [], []
            for t in texts:
                b = t.encode().translate(ASCII_LOWER)
                lead.append(b[:LEAD])
                sha.append(hashlib.sha256(b).digest())
            yield pd.DataFrame({"lead": lead, "sha": sha})
    finally:
        give_back()


_RUNS = "doc_id long, keep_id long, group_size long, sha binary, edge boolean, head boolean, once boolean"


def _runs(largest: bool):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours are compared in full; a run of equals leaves when it ends. The first and last run are edges."""
        schema = pa.schema([("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("sha", pa.binary()), ("edge", pa.bool_()), ("head", pa.bool_()), ("once", pa.bool_())])
        out: list[list] = [[] for _ in schema]
        before, sha, ids, first = None, None, [], True

        def leave(edge: bool) -> None:
            n = len(ids)
            for col, vals in zip(out, (ids, [max(ids) if largest else min(ids)] * n, [n] * n, [sha] * n, [edge] * n, [True] + [False] * (n - 1), [True, *(a != b for a, b in zip(ids, ids[1:], strict=False))]), strict=True):
                col.extend(vals)

        for b in batches:
            for i, t, s in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                t = t.translate(ASCII_LOWER)
                if ids and t == before:
                    ids.append(i)
                    continue
                if ids:
                    leave(first)
                    first = False
                before, sha, ids = t, s, [i]
            if len(out[0]) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                out = [[] for _ in schema]
        if ids:
            leave(True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return walk


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Every row with the row of its group that stays, the group's size and the digest of the normalised text.

    Texts are equal if identical once A-Z are lower-cased; null counts as empty. keep: "min" or "max" id stays. Rows
    are range-partitioned by splitters that Spark samples over (leading bytes, digest, id), a bounded key, sorted
    externally within each range, and each row is compared in full with its neighbour. The id in the key lets a hot
    text fall into several ranges; only the first and last run of a range can go on elsewhere, so at most two rows a
    range are merged across ranges, and only these are broadcast. Repeated rows (one id, equal texts) share
    the sort key, so they meet in one range, and only the first of them is kept. A null id counts as the largest.
    """
    small_batches(df)
    d = pick(df, id_col, text_col).withColumn("k", _key("text"))
    d = d.select("doc_id", "text", F.col("k.sha").alias("sha"), F.col("k.lead").alias("lead"))
    d = d.repartitionByRange("lead", "sha", "doc_id").sortWithinPartitions("lead", "sha", "doc_id")
    rows = materialised(d.select("doc_id", "text", "sha").mapInArrow(trimmed(_runs(keep == "max")), _RUNS), "runs")
    best = (F.max if keep == "max" else F.min)("keep_id")
    over = rows.where("edge and head").groupBy(F.col("sha").alias("_sha")).agg(best.alias("_keep"), F.sum("group_size").alias("_size"))
    rows = rows.join(F.broadcast(over), F.col("edge") & (F.col("sha") == F.col("_sha")), "left")
    return rows.select(
        id_out(F.col("doc_id")).alias("doc_id"),
        id_out(F.coalesce("_keep", "keep_id")).alias("keep_id"),
        F.coalesce("_size", "group_size").alias("group_size"),
        (F.col("once") & (F.col("doc_id") == F.coalesce("_keep", "keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def sha_of(text: Column) -> Column:
    """text_sha256 of groups() as a column."""
    return F.lower(F.hex(_key(text)["sha"]))


def op10_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


SQL_OP10 = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""
