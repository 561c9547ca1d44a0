"""The trip query over many questions at once: which zones can be gone to, why not, what to change, what to warn of.

A question is a row (query, origin, month, days, interests, budget, max_altitude, by_land, surprise). Questions are a
stated, small set; they meet the zones in blocks, and everything after that is joins on zone, origin and month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Minutes of a day out, of the longest visit, of a way that still counts as being at home; the most days of
# a trip; heights in metres from which a stop and a night are warned of; the share of a trip that may be road.
DAY_MIN, VISIT_MOST_MIN, HOME_MIN, DAYS_MOST = 480, 360, 30, 14
HIGH_STOP_M, HIGH_NIGHT_M, ROAD_SHARE, LONG_WALK_MIN = 3500, 2500, 0.4, 60

#: What keeps a trip from being made, in the order in which it is looked at.
REASONS = ("altitude_unknown", "too_high", "on_circuit", "at_home", "no_way", "too_short", "more_road_than_visit", "no_stops")


def stop_fits(max_altitude: Column, night: Column, altitude: Column, visit: Column, reach: Column) -> Column:
    """Whether a stop may be put into a day: reachable, a visit of at most six hours, not for the night only, and where
    the question limits the altitude, known to be within it."""
    low = max_altitude.isNull() | F.coalesce(altitude <= max_altitude, F.lit(False))
    return reach.isNotNull() & ~F.isnan(reach.cast("double")) & (visit <= VISIT_MOST_MIN) & ~F.coalesce(night, F.lit(False)) & low


def candidate_stops(pairs: DataFrame, stops: DataFrame) -> DataFrame:
    """Rows of pairs (query, zone, max_altitude, ...) by the stops of their zone that fit: (stop, zone, visit, altitude,
    night, reach, ...)."""
    s = stops.withColumnRenamed("zone", "_zone")
    fits = stop_fits(F.col("max_altitude"), F.col("night"), F.col("altitude"), F.col("visit"), F.col("reach"))
    return pairs.join(s, F.col("zone") == F.col("_zone")).where(fits).drop("_zone")


def road(minutes: Column, days: Column) -> tuple[Column, Column]:
    """Whole days that only the ways there and back take, and minutes left for visits. A trip of a day has no way of its
    own: its stops are reached from home."""
    whole = F.when(days > 1, 2 * F.floor(minutes / DAY_MIN)).otherwise(0)
    return whole, F.when(days > 1, days * DAY_MIN - 2 * F.ceil(minutes)).otherwise(F.lit(DAY_MIN))


def judged(queries: DataFrame, zones: DataFrame, access: DataFrame, stops: DataFrame) -> DataFrame:
    """Every question by every zone with minutes of the way, by_air, visit_minutes, n_stops and reason, the first of
    REASONS that holds; null if the trip can be made.

    zones: (zone, base, base_altitude, off_circuit); access: (origin, zone, land_minutes, air_minutes), null where there
    is no way. Questions are broadcast: they are the stated set, zones may be any number.
    """
    q = queries.select("query", "origin", "month", "days", "interests", "budget", "max_altitude", "by_land", "surprise")
    grid = zones.crossJoin(F.broadcast(q))
    grid = grid.join(access.withColumnsRenamed({"origin": "_o", "zone": "_z"}), (F.col("origin") == F.col("_o")) & (F.col("zone") == F.col("_z")), "left").drop("_o", "_z")
    land, air = F.col("land_minutes"), F.when(~F.col("by_land"), F.col("air_minutes"))
    flies = F.coalesce(air < land, air.isNotNull() & land.isNull())
    grid = grid.withColumn("by_air", flies & (F.col("days") > 1)).withColumn("minutes", F.when(flies, air).otherwise(land))
    # A zone's stops are counted per limit of altitude that questions have, once for all who share it.
    limits = queries.select("max_altitude").distinct()
    fits = stop_fits(F.col("_limit"), F.col("night"), F.col("altitude"), F.col("visit"), F.col("reach"))
    counts = stops.crossJoin(F.broadcast(limits.withColumnRenamed("max_altitude", "_limit"))).where(fits).groupBy(F.col("zone").alias("_z"), "_limit").agg(F.count(F.lit(1)).alias("n_stops"))
    grid = grid.join(counts, (F.col("zone") == F.col("_z")) & F.col("max_altitude").eqNullSafe(F.col("_limit")), "left").drop("_z", "_limit").fillna(0, ["n_stops"])
    whole, left = road(F.col("minutes"), F.col("days"))
    limit, height, stays = F.col("max_altitude"), F.col("base_altitude"), F.col("days") > 1
    tests = (
        limit.isNotNull() & height.isNull(),
        height > limit,
        F.col("surprise") & ~F.col("off_circuit"),
        stays & (land < HOME_MIN),
        stays & F.col("minutes").isNull(),
        stays & (left <= 0),
        stays & (whole > F.col("days") - whole),
        F.col("n_stops") == 0,
    )
    reason = F.coalesce(*(F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)))
    return grid.withColumn("visit_minutes", F.greatest(left, F.lit(0))).withColumn("reason", reason)


def trips(queries: DataFrame, zones: DataFrame, access: DataFrame, stops: DataFrame, season: DataFrame, best: int = 3) -> DataFrame:
    """Per question its best trips, at most one a base: value of the stops that serve its interests, by season, within
    what the visit's minutes allow; place 1.. ; zones (zone, base, ...), season (zone, month, factor)."""
    good = judged(queries, zones, access, stops).where("reason IS NULL")
    c = candidate_stops(good.select("query", "zone", "max_altitude", "interests", "visit_minutes"), stops.withColumnsRenamed({"interests": "_serves", "rank": "_rank"}))
    wanted = (F.size("interests") == 0) | F.arrays_overlap("interests", "_serves")
    c = c.withColumn("_value", F.coalesce("_rank", F.lit(1)) * F.when(wanted, 1.0).otherwise(0.5))
    w = Window.partitionBy("query", "zone").orderBy((F.col("_value") / F.greatest("visit", F.lit(1))).desc(), "stop").rowsBetween(Window.unboundedPreceding, 0)
    fill = c.withColumn("_used", F.sum("visit").over(w)).where(F.col("_used") <= F.col("visit_minutes"))
    value = fill.groupBy("query", "zone").agg(F.sum("_value").alias("value"), F.count(F.lit(1)).alias("planned"))
    scored = good.join(value, ["query", "zone"]).join(season.withColumnsRenamed({"zone": "_z", "month": "_m"}), (F.col("zone") == F.col("_z")) & (F.col("month") == F.col("_m")))
    scored = scored.withColumn("score", F.round(F.col("value") * F.col("factor"), 6))
    per_base = Window.partitionBy("query", "base").orderBy(F.col("score").desc(), "zone")
    scored = scored.withColumn("_b", F.row_number().over(per_base)).where("_b = 1")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "zone"))
    return scored.withColumn("place", place).where(F.col("place") <= best).select("query", "place", "zone", "base", "minutes", "by_air", "planned", "score")


def relaxed(queries: DataFrame, zones: DataFrame, access: DataFrame, stops: DataFrame) -> DataFrame:
    """For every question without a trip, each change of one field that gives one: (query, field, days, zones).

    Fields: days (the fewest more that do), by_land, max_altitude, surprise. All variants are judged in one batch.
    """
    none = judged(queries, zones, access, stops).groupBy("query").agg(F.count_if(F.col("reason").isNull()).alias("n")).where("n = 0").select("query")
    q = queries.join(none, "query", "left_semi")
    same = {c: F.col(c) for c in ("days", "by_land", "max_altitude", "surprise")}
    as_now = lambda **new: F.struct(*((new.get(k, v)).alias(k) for k, v in same.items()))
    longer = F.transform(F.when(F.col("days") < DAYS_MOST, F.sequence(F.col("days") + 1, F.lit(DAYS_MOST))).otherwise(F.array().cast("array<int>")), lambda d: F.struct(F.lit("days").alias("field"), as_now(days=d.cast("int")).alias("v")))
    one = lambda name, cond, **new: F.when(cond, F.struct(F.lit(name).alias("field"), as_now(**new).alias("v")))
    others = F.array_compact(F.array(one("by_land", F.col("by_land"), by_land=F.lit(False)), one("max_altitude", F.col("max_altitude").isNotNull(), max_altitude=F.lit(None).cast("int")), one("surprise", F.col("surprise"), surprise=F.lit(False))))
    v = q.withColumn("_v", F.explode(F.concat(longer, others)))
    v = v.select(F.struct("query", "_v.field", F.col("_v.v.days").alias("days")).alias("query"), "origin", "month", "interests", "budget", *(F.col(f"_v.v.{k}").alias(k) for k in same))
    found = judged(v, zones, access, stops).where("reason IS NULL").groupBy("query").agg(F.count(F.lit(1)).alias("zones"))
    found = found.select("query.*", "zones")
    fewest = Window.partitionBy("query", "field").orderBy("days")
    return found.withColumn("_r", F.row_number().over(fewest)).where("_r = 1").drop("_r")


def relaxed_twice(queries: DataFrame, zones: DataFrame, access: DataFrame, stops: DataFrame) -> DataFrame:
    """For every question without a trip that no single change gives one, each change of two fields that does: (query, field,
    other, days, zones). Fields as for relaxed(), days the fewest more that do, and always named first."""
    none = judged(queries, zones, access, stops).groupBy("query").agg(F.count_if(F.col("reason").isNull()).alias("n")).where("n = 0").select("query")
    once = relaxed(queries, zones, access, stops).select("query").distinct()
    q = queries.join(none, "query", "left_semi").join(once, "query", "left_anti")
    changes = {"by_land": (F.col("by_land"), F.lit(False)), "max_altitude": (F.col("max_altitude").isNotNull(), F.lit(None).cast("int")), "surprise": (F.col("surprise"), F.lit(False))}
    names = [*changes]
    now = {"days": F.col("days").cast("int"), "by_land": F.col("by_land"), "max_altitude": F.col("max_altitude").cast("int"), "surprise": F.col("surprise")}

    def variant(field: str, other: str, **new: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(other).alias("other"), *((new.get(k, v)).alias(k) for k, v in now.items()))

    longer = F.when(F.col("days") < DAYS_MOST, F.sequence((F.col("days") + 1).cast("int"), F.lit(DAYS_MOST))).otherwise(F.array().cast("array<int>"))

    def with_days(x: str) -> Column:
        return F.when(changes[x][0], F.transform(longer, lambda d: variant("days", x, days=d, **{x: changes[x][1]})))

    both = [F.when(changes[x][0] & changes[y][0], F.array(variant(x, y, **{x: changes[x][1], y: changes[y][1]}))) for k, x in enumerate(names) for y in names[k + 1 :]]
    v = q.withColumn("_v", F.explode(F.flatten(F.array_compact(F.array(*map(with_days, names), *both)))))
    v = v.select(F.struct("query", "_v.field", "_v.other", "_v.days").alias("query"), "origin", "month", "interests", "budget", *(F.col(f"_v.{k}").alias(k) for k in now))
    found = judged(v, zones, access, stops).where("reason IS NULL").groupBy("query").agg(F.count(F.lit(1)).alias("zones")).select("query.*", "zones")
    fewest = Window.partitionBy("query", "field", "other").orderBy("days")
    return found.withColumn("_r", F.row_number().over(fewest)).where("_r = 1").drop("_r")


#: Warnings in their fixed order: name and the condition on columns of a trip.
WARNINGS: tuple[tuple[str, str], ...] = (
    ("safety", "unsafe_zone IS NOT NULL"),
    ("season", "verdict <> 'viable'"),
    ("interests", "size(array_except(interests, covered)) > 0"),
    ("high_stops", f"highest_stop >= {HIGH_STOP_M}"),
    ("acclimatise", f"days > 1 AND base_altitude >= {HIGH_NIGHT_M}"),
    ("budget", "p50 > budget"),
    ("budget_margin", "p50 <= budget AND p80 > budget"),
    ("flight", "by_air"),
    ("few_flights", "by_air AND flights_a_month < 30"),
    ("night_bus", "night_bus"),
    ("train", "by_train"),
    ("tickets", "capped_tickets > 0"),
    ("long_walk", f"longest_walk >= {LONG_WALK_MIN}"),
    ("closed_days", "start_date IS NULL AND closing_stops > 0"),
    ("road_share", f"days > 1 AND road_minutes >= {ROAD_SHARE} * days * {DAY_MIN}"),
    ("free_days", "free_days > 0"),
    ("regional_climate", "climate_source <> 'zone'"),
    ("altitude_unknown", "days > 1 AND base_altitude IS NULL"),
    ("no_nightlife", "wants_night AND days > 1 AND night_places = 0"),
)


def warnings() -> Column:
    """Array of the names of WARNINGS that hold for a trip's row, in their order; a null condition doesn't hold."""
    return F.array_compact(F.array(*(F.when(F.expr(cond), F.lit(name)) for name, cond in WARNINGS)))


#: Reasons to go, in their fixed order; the first four that hold are named.
MERITS: tuple[tuple[str, str], ...] = (
    ("high_rank", "high_rank_stops > 0"),
    ("all_serve", "serving = stops AND stops > 0 AND size(interests) > 0"),
    ("some_serve", "serving > 0 AND serving < stops AND size(interests) > 0"),
    ("night_out", "wants_night AND night_places > 0 AND days > 1"),
    ("dry_season", "verdict = 'viable' AND rain < 50"),
    ("event", "events > 0"),
    ("off_circuit", "off_circuit"),
    ("near", "days > 1"),
)


def merits() -> Column:
    """The first four of MERITS that hold."""
    return F.slice(F.array_compact(F.array(*(F.when(F.expr(cond), F.lit(name)) for name, cond in MERITS))), 1, 4)
