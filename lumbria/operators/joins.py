"""Joins that equality doesn't express: by radius, nearest, overlapping interval, nearest in time, best two legs.

Each is an equi-join on a cell that both sides share, followed by the exact test; no plan here holds a cross join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RADIUS_KM, haversine_km
from ..session import materialised


def radius_join(left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lon: str = "lon", out: str = "km", on: list[str] | None = None) -> DataFrame:
    """All pairs at most km apart, with their distance. Right columns lat and lon come as r_lat and r_lon. on: columns that
    both sides have and that must be equal besides.

    The earth is cut into bands of km from south to north, and each band into as many columns as fit its poleward edge,
    so that near a pole a band is one column; columns wrap at 180 degrees. The left side is copied into the cells around
    its own, in the bands above and below by their own columns; the right side isn't copied. Null or nan coordinates
    match nothing.
    """
    step = math.degrees(km / RADIUS_KM) * 1.0001
    reach = math.sin(min(math.pi / 2, km / RADIUS_KM * 1.0001))
    band = lambda c: F.floor((c + 90) / step).cast("int")

    def columns(y: Column) -> Column:
        edge = F.least(F.greatest(F.abs(y * step - 90), F.abs((y + 1) * step - 90)) + step, F.lit(90.0))
        ratio = reach / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
        return F.when(ratio >= 1, 1).otherwise(F.greatest(F.floor(360 / F.degrees(F.asin(F.least(ratio, F.lit(1.0))))), F.lit(1))).cast("int")

    cell = lambda c, n: F.pmod(F.floor((c + 180) * n / 360).cast("int"), n)
    there = lambda d: d.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(F.col(lat).cast("double")) & ~F.isnan(F.col(lon).cast("double")))
    a = there(left).withColumn("_y", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: band(F.col(lat)) + k)))
    beside = F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.pmod(cell(F.col(lon), columns(F.col("_y"))) + k, columns(F.col("_y")))))
    a = a.withColumn("_x", F.explode(beside))
    b = there(right).withColumn("_y", band(F.col(lat))).withColumn("_x", cell(F.col(lon), columns(F.col("_y")))).withColumnsRenamed({lat: "r_lat", lon: "r_lon"})
    d = haversine_km(F.col(lat), F.col(lon), F.col("r_lat"), F.col("r_lon"))
    return a.join(b, ["_y", "_x", *(on or [])]).withColumn(out, d).where(F.col(out) <= km).drop("_y", "_x")


#: Comparisons of a radius join that are not worth a smaller ring.
FEW_PAIRS = 8_000_000


def bounded_km(left: DataFrame, right: DataFrame, km: float, most: float, on: list[str] | None = None) -> float:
    """The largest of km, km / 4, km / 16, ... within which a radius join compares about `most` right rows a left row, or
    FEW_PAIRS in all, as counted in squares of that size; km / 4096 at least."""
    steps = 7
    levels = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_m")

    def squares(d: DataFrame, name: str) -> DataFrame:
        step = F.lit(math.degrees(km / RADIUS_KM)) / F.pow(F.lit(4.0), F.col("_m"))
        y = F.floor((F.col("lat") + 90) / step)
        x = F.floor((F.col("lon") + 180) * F.cos(F.radians(F.least((y + 0.5) * step - 90, F.lit(90.0)))) / step)
        return d.select("*", levels).groupBy("_m", *(on or []), y.alias("_y"), x.alias("_x")).agg(F.count(F.lit(1)).alias(name))

    rows, others = left.count(), right.count()
    if rows * others <= FEW_PAIRS:
        return km
    own = squares(left, "a").join(squares(right, "b"), ["_m", *(on or []), "_y", "_x"])
    met = {r["_m"]: r["n"] for r in own.groupBy("_m").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("n")).collect()}
    return km / 4 ** next((m for m in range(steps) if 9 * met.get(m, 0.0) <= max(most * rows, FEW_PAIRS)), steps - 1)


def nearest(left: DataFrame, right: DataFrame, key: list[str], tie: list[str], km: float, k: int = 1, first_km: float | None = None, on: list[str] | None = None) -> DataFrame:
    """Of each left row the k nearest right rows within km, by distance, then tie, columns of right; `place` from 1. on:
    columns that both sides have and that must be equal besides.

    Places are compared, not rows: left rows of one place find the same, and of right rows of one place no more than the
    first k by tie can be among the nearest. Rings: places that find k within first_km (as far as a bounded number of
    rows is compared, unless given) are done, as nothing beyond can be nearer; only the others look farther, four times as far
    a round.
    """
    on = on or []
    at = [*on, "lat", "lon"]
    there = lambda d: d.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(double(lat)) AND NOT isnan(double(lon))")
    spots = materialised(there(left).select(*at).distinct(), "spots")
    here = there(right).withColumn("_nth", F.row_number().over(Window.partitionBy(*at).orderBy(*tie))).where(F.col("_nth") <= k).drop("_nth")
    here = materialised(here, "places")
    w = Window.partitionBy(*at).orderBy("km", *tie)
    ranked = lambda d, r: radius_join(d, here, r, on=on).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")
    todo, r, out = spots, first_km or bounded_km(spots, here, km, 64.0 * k, on), None
    while r < km and not (out is not None and todo.isEmpty()):
        found = materialised(ranked(todo, r), "ring")
        done = found.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select(*at)
        part = found.join(done, at, "left_semi")
        out = part if out is None else out.unionByName(part)
        todo = materialised(todo.join(done, at, "left_anti"), "left")
        r *= 4
    last = ranked(todo, km)
    out = last if out is None else out.unionByName(last)
    mine = [c for c in right.columns if c not in at]
    both = left.join(out.select(*at, *mine, "r_lat", "r_lon", "km"), at).select(*left.columns, *mine, "r_lat", "r_lon", "km")
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("km", *tie))).where(F.col("place") <= k)


def overlap_join(left: DataFrame, right: DataFrame, start: str, end: str, r_start: str, r_end: str, on: list[str] | None = None, days: int = 31) -> DataFrame:
    """Pairs whose closed date intervals share a day. Both sides are copied into blocks of so many days, and a pair is
    taken only in the later of the two first blocks, so once."""
    block = lambda c: F.floor(F.unix_date(F.col(c)) / days)
    a = left.withColumn("_first", block(start)).withColumn("_b", F.explode(F.sequence(F.col("_first"), F.greatest("_first", block(end)))))
    b = right.withColumn("_rfirst", block(r_start)).withColumn("_b", F.explode(F.sequence(F.col("_rfirst"), F.greatest("_rfirst", block(r_end)))))
    pairs = a.join(b, [*(on or []), "_b"])
    return pairs.where((F.col(start) <= F.col(r_end)) & (F.col(end) >= F.col(r_start)) & (F.col("_b") == F.greatest("_first", "_rfirst"))).drop("_first", "_rfirst", "_b")


def asof_nearest(targets: DataFrame, seen: DataFrame, key: list[str], at: str, seen_at: str, tolerance_s: int, tie: list[str], target_key: list[str]) -> DataFrame:
    """For each target its nearest observation of the same key within the tolerance, by gap, then tie. Times fall into
    blocks of the tolerance's length, and targets look into the blocks beside their own."""
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    a = targets.withColumn("_b", F.explode(F.transform(F.expr("array(-1L, 0L, 1L)"), lambda k: k + F.floor(sec(at) / tolerance_s))))
    b = seen.withColumn("_b", F.floor(sec(seen_at) / tolerance_s))
    pairs = a.join(b, [*key, "_b"]).withColumn("gap_s", F.abs(sec(seen_at) - sec(at))).where(F.col("gap_s") <= tolerance_s)
    w = Window.partitionBy(*target_key).orderBy("gap_s", *tie)
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_b")


def pairs_within(df: DataFrame, group: list[str], key: str, cols: list[str]) -> DataFrame:
    """Unordered pairs of one group, key < r_key; for groups that are bounded by nature, such as the stops of a zone."""
    a = df.select(*group, key, *cols)
    b = df.select(*group, F.col(key).alias(f"r_{key}"), *(F.col(c).alias(f"r_{c}") for c in cols))
    return a.join(b, group).where(F.col(key) < F.col(f"r_{key}"))


#: Tasks that the last legs of best_two_legs are dealt over, and parts that the rows of one link fall into.
LEGS, LEG_PARTS = 256, 16


def best_two_legs(first: DataFrame, middle: DataFrame, last: DataFrame, from_key: str, to_key: str, via: tuple[str, str]) -> DataFrame:
    """Cheapest way from, via a link of middle, to: first(from, via0, cost), middle(via0, via1, cost), last(via1, to, cost).

    A pair that only one way joins is done with the join; only pairs that may have several are put together by a shuffle.
    The join's rows are as many as the ways, so it is dealt over many tasks, a link's rows over several."""
    a, b = via
    total = F.col("c1") + F.col("c2") + F.col("c3")
    least = lambda d, keys, c: d.groupBy(*keys).agg(F.min(F.struct("cost")).alias("_c")).select(*keys, F.col("_c.cost").alias(c))
    alone = lambda *keys: F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1
    to_link = least(first, [from_key, a], "c1").join(least(middle, [a, b], "c2"), a).withColumn("_one", alone(from_key, b))
    from_link = least(last.where(F.col(b).isNotNull()), [b, to_key], "c3").withColumn("_single", alone(to_key))
    dealt = to_link.withColumn("_part", F.pmod(F.xxhash64(from_key, a), F.lit(LEG_PARTS))).repartition(LEGS, b, "_part")
    copied = from_link.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(LEG_PARTS - 1)).cast("array<bigint>"))).repartition(LEGS, b, "_part")
    legs = dealt.join(copied, [b, "_part"])
    several = legs.where("NOT (_one AND _single)").groupBy(from_key, to_key).agg(F.min(F.struct(total.alias("total"), F.col(a), F.col(b))).alias("best")).select(from_key, to_key, "best.total", f"best.{a}", f"best.{b}")
    return legs.where("_one AND _single").select(from_key, to_key, total.alias("total"), a, b).unionByName(several)


def distance_to_group_median(df: DataFrame, group: str, key: str, lat: str, lon: str) -> DataFrame:
    """Each point's distance to the median point of the others of its group; null if it is alone.

    Leaving one out moves a sorted list's middle by at most one place, so the medians of the others come from the three
    values in a group's middle and the point's own rank: points are numbered by a sort, and a row a group is joined.
    """
    rows = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(key, group, F.col(lat).alias("_la"), F.col(lon).alias("_lo"))
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    for c in ("_la", "_lo"):
        rows = rows.withColumn(f"{c}_at", F.row_number().over(Window.partitionBy(group).orderBy(c, key)) - 1)
    low = F.floor((F.col("_n") - 2) / 2)
    middle = rows.join(n, group)
    value = lambda c, k: F.max(F.when(F.col(f"{c}_at") == low + k, F.col(c))).alias(f"{c}{k}")
    near = (F.col("_la_at").between(low, low + 2)) | (F.col("_lo_at").between(low, low + 2))
    middle = middle.where(near).groupBy(group, "_n").agg(*(value(c, k) for c in ("_la", "_lo") for k in (0, 1, 2)))

    def other(c: str) -> Column:
        pick = lambda k: F.when(low + k >= F.col(f"{c}_at"), F.col(f"{c}{k + 1}")).otherwise(F.col(f"{c}{k}"))
        return F.when(F.col("_n") > 1, F.when(F.col("_n") % 2 == 0, pick(0)).otherwise((pick(0) + pick(1)) / 2))

    return rows.join(middle, group).select(key, group, haversine_km(F.col("_la"), F.col("_lo"), other("_la"), other("_lo")).alias("km"))
