"""Gapless positions within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_slots(df: DataFrame, group: str, order: list[str], out: str, spread: list[str] | None = None, rows_per_block: int = 50_000) -> DataFrame:
    """Adds out: 0, 1, 2, ... within each value of group.

    Rows are dealt into (group, block) cells by a hash of the spread columns (the order columns, unless given); cells
    are counted (one row a cell), the counts are summed up along the blocks, and each cell numbers its own rows. A
    group of any size is thus spread over as many tasks as it has blocks. df is read twice: pass a cheap or
    materialised one. Rows that agree in all order columns take their places in any order.
    """
    n = df.count()
    cells = max(1, -(-n // rows_per_block))
    d = df.withColumn("_block", F.pmod(F.xxhash64(*(spread or order)), F.lit(cells)))
    cell = d.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    start = cell.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order)) - 1
    return (
        d.withColumn("_at", number)
        .join(start.withColumnRenamed(group, "_g").withColumnRenamed("_block", "_b"), (F.col(group).eqNullSafe(F.col("_g"))) & (F.col("_block") == F.col("_b")))
        .withColumn(out, F.col("_start") + F.col("_at"))
        .drop("_block", "_at", "_g", "_b", "_start")
    )
