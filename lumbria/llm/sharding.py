"""Sharding by jump consistent hashing: no ring table, and an appended shard only takes rows into itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .slots import with_slots
from .textcols import id_in, id_out


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, all keys at once (Lamping and Veach, 2014)."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = keys.astype(np.uint64, copy=True)
    at, nxt = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = nxt[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            nxt[live] = ((at[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
            live = live[nxt[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a 64-bit hash column. Only that column goes to Python."""

    @F.pandas_udf("int")
    def _jump(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(jump(s.to_numpy(np.int64, na_value=0).view(np.uint64), shards))

    return _jump(key)


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """Every row's shard, its size, its gapless slot there and its shard if one more were appended.

    The stable key is the id's 64-bit hash, so id and shard count decide alone: rows of one id, repeated ones
    included, share a shard. Size: the text's UTF-8 bytes plus 1; a null text has none, and the crc of an empty one.
    A null id is a key like any other. Only id, size and crc are shuffled, never the texts. Extra columns are ignored;
    an empty table gives an empty result.
    """
    rows = df.select(
        id_in(df[id_col]).alias("doc_id"),
        (F.coalesce(F.octet_length(df[text_col]), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(df[text_col], F.lit(""))).alias("text_crc32"),
    )
    key = F.xxhash64("doc_id")
    rows = rows.withColumn("shard", shard_of(key, shards)).withColumn("grown_shard", shard_of(key, shards + 1))
    out = with_slots(rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return out.select(id_out(F.col("doc_id")).alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
