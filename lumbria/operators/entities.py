"""The same place in two sources, by its words and by where it lies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .joins import nearest, radius_join


def entities(left: DataFrame, right: DataFrame, words: str, km: float, share: float, share_km: float) -> DataFrame:
    """(id, s_id, jaccard): each left row's best partner of right (s_id), by the Jaccard share of their words, arrays
    without repeats, then the nearest: equal words within km, or at least `share` of them within share_km.

    Equal words are an equality, so the nearest of those is looked for first. What finds none is held against places
    that have one of its rarer words: of two sets that share so much, the rarest few of each have one in common."""
    at = ["_w", "lat", "lon"]
    a = left.select("id", F.array_sort(words).alias("_w"), "lat", "lon")
    spots = materialised(a.select(*at).distinct(), "spots")
    b = right.groupBy(F.array_sort(words).alias("_w"), "lat", "lon").agg(F.min("s_id").alias("s_id"))
    b = materialised(b, "places")
    equal = materialised(nearest(spots, b, at, ["s_id"], km, on=["_w"]).select(*at, "s_id", F.lit(1.0).alias("jaccard"), "km"), "equal")
    rest = materialised(spots.join(equal, at, "left_anti"), "rest")
    sets = materialised(rest.select("_w").unionByName(b.select("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("n")), "sets")
    each = sets.select("_w", "n", F.explode("_w").alias("word"))
    often = each.groupBy("word").agg(F.sum("n").alias("often"))
    rare = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("often", "word"))), lambda x: x["word"]), 1, (F.size("_w") - F.ceil(F.lit(share) * F.size("_w") - 1e-9) + 1).cast("int"))
    rare = materialised(each.join(often, "word").groupBy("_w").agg(rare.alias("rare")), "rare")
    by = lambda d: d.join(rare, "_w").withColumn("_rare", F.explode("rare")).drop("rare")
    pairs = radius_join(by(rest), by(b).withColumnRenamed("_w", "_rw"), share_km, on=["_rare"])
    jaccard = F.size(F.array_intersect("_w", "_rw")) / F.size(F.array_union("_w", "_rw"))
    close = pairs.withColumn("jaccard", jaccard).where(F.col("jaccard") >= share).groupBy(*at).agg(F.min(F.struct((-F.col("jaccard")).alias("m"), "km", "s_id")).alias("b"))
    found = equal.unionByName(close.select(*at, "b.s_id", (-F.col("b.m")).alias("jaccard"), "b.km"))
    best = a.join(found, at).groupBy("id").agg(F.min(F.struct((-F.col("jaccard")).alias("m"), "km", "s_id")).alias("b"))
    return best.select("id", "b.s_id", (-F.col("b.m")).alias("jaccard"))
