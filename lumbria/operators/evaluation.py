"""Ranking metrics, agreement between raters, intervals and checks of distances."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised

#: Grades from which a proposal is recommendable, and under which it doesn't fit.
GOOD, POOR = 1.5, 0.5


def ranking_metrics(ranked: DataFrame, query: str = "query", place: str = "place", grade: str = "grade", k: int = 3) -> DataFrame:
    """Per query: ndcg, precision and misfit share at k, and the reciprocal place of the first good one.

    ranked holds all graded options of a query; those with a place are the proposals. The ideal order is over all.
    """
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.col(grade).desc()))
    gain = lambda at: F.when(at <= k, F.col(grade) / F.log2(at + 1.0))
    r = ranked.withColumn("_b", best)
    top = F.col(place) <= k
    good = top & (F.col(grade) >= GOOD)
    g = r.groupBy(query).agg(
        F.coalesce(F.sum(F.when(top, gain(F.col(place)))), F.lit(0.0)).alias("dcg"), F.sum(gain(F.col("_b"))).alias("ideal"),
        F.count_if(good).alias("n_good"), F.count_if(top & (F.col(grade) < POOR)).alias("n_poor"), F.min(F.when(good, F.col(place))).alias("first"),
    )
    return g.select(query, F.coalesce(F.try_divide(F.col("dcg"), F.when(F.col("ideal") > 0, F.col("ideal"))), F.lit(0.0)).alias("ndcg"), (F.col("n_good") / k).alias("precision"), (F.col("n_poor") / k).alias("misfits"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal"))


def fleiss_kappa(grades: DataFrame, unit: str = "unit", grade: str = "grade") -> DataFrame:
    """One row, kappa, of long grades in which each unit has as many raters."""
    n = grades.groupBy(unit, grade).agg(F.count(F.lit(1)).cast("double").alias("n"))
    per = n.groupBy(unit).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("s"))
    agree = per.agg(F.avg(F.col("s") / (F.col("m") * (F.col("m") - 1))).alias("p"))
    chance = n.groupBy(grade).agg(F.sum("n").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("q"), F.sum("c").alias("t")).select((F.col("q") / (F.col("t") * F.col("t"))).alias("e"))
    return agree.crossJoin(chance).select(F.when(F.col("e") < 1, (F.col("p") - F.col("e")) / (1 - F.col("e"))).otherwise(F.lit(1.0)).alias("kappa"))


def krippendorff_alpha(grades: DataFrame, unit: str = "unit", grade: str = "grade", ordinal: bool = True) -> DataFrame:
    """One row, alpha. Coincidences come from counts per unit and grade, so a unit with many raters is never paired up."""
    n = grades.where(F.col(grade).isNotNull()).groupBy(unit, grade).agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("m", F.sum("n").over(Window.partitionBy(unit))).where("m >= 2")
    a, b = n.select(unit, F.col(grade).alias("c"), "n", "m"), n.select(unit, F.col(grade).alias("k"), F.col("n").alias("nk"))
    pairs = a.join(b, unit).groupBy("c", "k").agg(F.sum(F.when(F.col("c") == F.col("k"), F.col("n") * (F.col("n") - 1)).otherwise(F.col("n") * F.col("nk")) / (F.col("m") - 1)).alias("o"))
    margin = n.groupBy(F.col(grade).alias("v")).agg(F.sum("n").alias("nv"))
    upto = margin.withColumn("s", F.sum("nv").over(Window.orderBy("v")))
    x, y = upto.select(F.col("v").alias("c"), F.col("nv").alias("nc"), F.col("s").alias("sc")), upto.select(F.col("v").alias("k"), F.col("nv").alias("nk"), F.col("s").alias("sk"))
    between = F.when(F.col("sc") <= F.col("sk"), F.col("sk") - F.col("sc") + F.col("nc")).otherwise(F.col("sc") - F.col("sk") + F.col("nk"))
    far = F.pow(between - (F.col("nc") + F.col("nk")) / 2, F.lit(2.0)) if ordinal else F.lit(1.0)
    d = F.when(F.col("c") == F.col("k"), F.lit(0.0)).otherwise(far)
    grid = x.crossJoin(y).withColumn("d", d).join(pairs, ["c", "k"], "left")
    t = grid.agg(F.sum(F.coalesce("o", F.lit(0.0)) * F.col("d")).alias("seen"), F.sum(F.col("nc") * F.col("nk") * F.col("d")).alias("due")).crossJoin(margin.agg(F.sum("nv").alias("t")))
    return t.select(F.when(F.col("due") == 0, F.lit(1.0)).otherwise(1 - (F.col("t") - 1) * F.col("seen") / F.col("due")).alias("alpha"))


def compared(pairs: DataFrame, a: str, b: str, times: int = 10_000, seed: int = 12, most: int = 100_000) -> DataFrame:
    """Mean difference of a and b, wins, losses, ties, a 95 % bootstrap interval and Wilcoxon's signed-rank p (normal
    approximation, ties corrected). One row per query is compared: a bounded evaluation set, handled in one group; more than
    `most` rows are an error."""
    if pairs.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows to compare")

    def one(p: pd.DataFrame) -> pd.DataFrame:
        d = (p[a] - p[b]).tolist()
        rng, n = random.Random(seed), len(d)
        means = sorted(sum(rng.choices(d, k=n)) / n for _ in range(times))
        nz = sorted((abs(x), x > 0) for x in d if x)
        p_value = None
        if len(nz) >= 6:
            ranks, ties, i = [0.0] * len(nz), 0.0, 0
            while i < len(nz):
                j = i
                while j < len(nz) and nz[j][0] == nz[i][0]:
                    j += 1
                for q in range(i, j):
                    ranks[q] = (i + j + 1) / 2
                ties += (j - i) ** 3 - (j - i)
                i = j
            m = len(nz)
            w = sum(r for r, (_, up) in zip(ranks, nz, strict=True) if up)
            var = m * (m + 1) * (2 * m + 1) / 24 - ties / 48
            p_value = math.erfc(abs(w - m * (m + 1) / 4) / math.sqrt(2 * var)) if var > 0 else None
        return pd.DataFrame([{"mean": sum(d) / n, "low": means[int(0.025 * times)], "high": means[int(0.975 * times) - 1], "wins": sum(x > 0 for x in d), "losses": sum(x < 0 for x in d), "ties": sum(x == 0 for x in d), "wilcoxon_p": p_value}])

    return pairs.select(a, b).groupBy(F.lit(1).alias("_g")).applyInPandas(lambda k, p: one(p), "mean double, low double, high double, wins long, losses long, ties long, wilcoxon_p double")


def _replicates(times: int, seed: int):
    """Sums under Poisson weights: (replicate, weight, total) of all rows (h, d), h a row's own hash."""
    # Chances of 0, 1, 2, ... draws of a row, of which all but 1e-12 are under 16.
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros(times), np.zeros(times)
        salt = np.random.default_rng(seed).integers(1, 2**63, times, dtype=np.uint64)
        for b in batches:
            h, d = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for s in range(0, len(h), 512):
                x = h[s : s + 512, None] ^ salt
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
                w = np.searchsorted(steps, (x >> np.uint64(11)) / float(1 << 53), side="right")
                weight += w.sum(0)
                total += d[s : s + 512] @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(times)), pa.array(weight), pa.array(total)], names=["replicate", "weight", "total"])

    return run


def bootstrap_interval(rows: DataFrame, key: list[str], value: str, times: int = 1000, share: float = 0.95, seed: int = 12) -> DataFrame:
    """(low, high): the interval of the mean that holds share of its bootstrap replicates, over any number of rows.

    Instead of drawing rows, each row counts as often in a replicate as a Poisson draw of mean one says, which a hash of
    its key decides: one pass, a task gives `times` sums, and rows never meet. Null values don't count; rows that share
    a key are drawn together. Without rows both are null."""
    d = rows.select(F.xxhash64(*key).alias("h"), F.col(value).cast("double").alias("d")).where("d IS NOT NULL")
    means = d.mapInArrow(_replicates(times, seed), "replicate long, weight double, total double").groupBy("replicate").agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("m"))
    tail = (1 - share) / 2
    return means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))


def signed_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(n, mean, wins, losses, ties, w_plus, z) of differences: of those other than 0 the sum of the positive ones' ranks by
    size, equal ones sharing theirs, and how many standard deviations it lies off what no difference would give.

    Equal sizes are counted first. Their counts are summed up along ranges of sizes, each range's own by itself, and only
    the ranges' totals are summed up together: no task sees all rows. z is null under six differences."""
    d = rows.select(F.col(value).cast("double").alias("d")).where("d IS NOT NULL")
    sizes = d.where("d <> 0").groupBy(F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    sizes = materialised(sizes.repartitionByRange("size").withColumn("part", F.spark_partition_id()), "sizes")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.groupBy("part").agg(F.sum("n").alias("t")).select("part", F.coalesce(F.sum("t").over(before().orderBy("part")), F.lit(0)).alias("start"))
    ranked = sizes.join(F.broadcast(starts), "part").withColumn("low", F.col("start") + F.coalesce(F.sum("n").over(before("part").orderBy("size")), F.lit(0)))
    w = ranked.agg(F.coalesce(F.sum(F.col("up") * (F.col("low") + (F.col("n") + 1) / 2)), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("m"), F.coalesce(F.sum(F.pow("n", F.lit(3)) - F.col("n")), F.lit(0.0)).alias("same"))
    all_ = d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"))
    m = F.col("m")
    spread = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("same") / 48)
    return all_.crossJoin(w).select("n", "mean", "wins", "losses", "ties", "w_plus", F.when((m >= 6) & (spread > 0), (F.col("w_plus") - m * (m + 1) / 4) / spread).alias("z"))


def triangle_excess(edges: DataFrame, group: str) -> DataFrame:
    """Per group the most by which a way a-c exceeds a-b-c; edges (group, src, dst, cost), groups bounded by nature."""
    ab, bc, ac = (edges.select(group, F.col("src").alias(s), F.col("dst").alias(d), F.col("cost").alias(c)) for s, d, c in (("a", "b", "x"), ("b", "c", "y"), ("a", "c", "z")))
    t = ab.join(bc, [group, "b"]).where("a <> c").join(ac, [group, "a", "c"])
    return t.groupBy(group).agg(F.max(F.col("z") - F.col("x") - F.col("y")).alias("excess"))


def sus_score(items: list[Column]) -> Column:
    """System usability score of ten answers from 1 to 5: odd ones count up, even ones down."""
    total = F.lit(0)
    for k, c in enumerate(items):
        total = total + (c - 1 if k % 2 == 0 else 5 - c)
    return total * F.lit(2.5)
