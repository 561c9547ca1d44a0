"""Profiles, comparisons and reshaping of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """A row a column: n, nulls, percent null, distinct, texts with outer blanks, and the share within its range.
    All columns are measured in one pass, and the one wide row is unpivoted."""
    aggs, parts = [F.count(F.lit(1)).alias("_n")], []
    for c, kind in df.dtypes:
        low, high = (ranges or {}).get(c, (None, None))
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"{c}__null"),
            F.countDistinct(c).alias(f"{c}__distinct"),
            F.count_if(F.col(c) != F.trim(c)).alias(f"{c}__blank") if kind == "string" else F.lit(0).cast("long").alias(f"{c}__blank"),
            F.avg(F.col(c).between(low, high).cast("int")).alias(f"{c}__in") if low is not None else F.lit(None).cast("double").alias(f"{c}__in"),
        ]
        parts.append(f"named_struct('column', '{c}', 'n', _n, 'nulls', `{c}__null`, 'null_percent', try_divide(100.0D * `{c}__null`, _n), 'distinct', `{c}__distinct`, 'blank', `{c}__blank`, 'in_range', `{c}__in`)")
    return df.agg(*aggs).select(F.expr(f"inline(array({', '.join(parts)}))"))


def missing_by(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Per value of group and column: rows, missing and their percent."""
    parts = ", ".join(f"named_struct('column', '{c}', 'missing', `{c}`)" for c in cols)
    wide = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(c).isNull()).alias(c) for c in cols))
    return wide.select(group, "total", F.expr(f"inline(array({parts}))")).withColumn("percent", F.try_divide(F.lit(100.0) * F.col("missing"), F.col("total")))


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) for each of cols, from one scan: columns are stacked, then counted."""
    parts = ", ".join(f"named_struct('column', '{c}', 'value', CAST(`{c}` AS STRING))" for c in cols)
    return df.select(F.expr(f"inline(array({parts}))")).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], ignored: tuple[str, ...] = ()) -> DataFrame:
    """(column, n): how many keys are new, gone or changed, and how many changed in each column."""
    cols = [c for c in new.columns if c not in key and c not in ignored and c in old.columns]
    a = old.select(*key, *(F.col(c).alias(f"_old_{c}") for c in cols), F.lit(True).alias("_o"))
    b = new.select(*key, *cols, F.lit(True).alias("_n"))
    j = a.join(b, key, "full_outer")
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    differs = {c: both & ~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in cols}
    some = F.lit(False)
    for d in differs.values():
        some = some | d
    aggs = [F.count_if(F.col("_o").isNull()).alias("_in"), F.count_if(F.col("_n").isNull()).alias("_out"), F.count_if(some).alias("_changed"), *(F.count_if(d).alias(f"_c_{c}") for c, d in differs.items())]
    parts = [("+", "_in"), ("-", "_out"), ("*", "_changed"), *((c, f"_c_{c}") for c in cols)]
    return j.agg(*aggs).select(F.expr(f"inline(array({', '.join(f"named_struct('column', '{n}', 'n', `{c}`)" for n, c in parts)}))"))


def classify_changes(old: DataFrame, new: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Each key of either side as gained, lost, new, gone, worse, better or same; a null value is no route."""
    j = old.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_o")).join(new.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_n")), key, "full_outer")
    a, b = F.col("_a"), F.col("_b")
    kind = (
        F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "gone").when(a.isNull() & b.isNotNull(), "gained").when(a.isNotNull() & b.isNull(), "lost")
        .when(b > a * (1 + tolerance), "worse").when(b < a * (1 - tolerance), "better").otherwise("same")
    )
    return j.select(*key, kind.alias("change"))


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def mode_of(df: DataFrame, group: list[str], col: str) -> DataFrame:
    """Most frequent value of each group, the smallest at a tie."""
    n = df.where(F.col(col).isNotNull()).groupBy(*group, col).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(col))).alias("b")).select(*group, F.col(f"b.{col}").alias(col), (-F.col("b.k")).alias("n"))


def min_max_scaled(df: DataFrame, col: str, out: str) -> DataFrame:
    """Scaled to 0..1 over the whole table; a constant column gives 0."""
    ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.coalesce(F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")


def partition_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of rows together in both, in a only, in b only, and the adjusted Rand index of the two partitions."""
    two = lambda c: c * (c - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    t = cells.agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("pa"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("pb"))
    x = t.crossJoin(rows).crossJoin(cols)
    expected = F.try_divide(F.col("pa") * F.col("pb"), two(F.col("total")))
    ari = F.try_divide(F.col("both") - expected, (F.col("pa") + F.col("pb")) / 2 - expected)
    return x.select("both", (F.col("pa") - F.col("both")).alias("only_a"), (F.col("pb") - F.col("both")).alias("only_b"), ari.alias("ari"))


def top_sum(df: DataFrame, group: list[str], col: str, k: int) -> DataFrame:
    """Sum of each group's k largest values, by rank: a group is never gathered into one list."""
    w = Window.partitionBy(*group).orderBy(F.col(col).desc())
    return df.where(F.col(col).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(*group).agg(F.sum(col).alias("top_sum"))


def best_distinct(df: DataFrame, distinct: str, order: list[Column], k: int) -> DataFrame:
    """The k best rows of which no two share a value of distinct."""
    w = Window.partitionBy(distinct).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy(*order).limit(k)
