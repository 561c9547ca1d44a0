"""Trip search with real day plans: zones planned best first, and no further than their bounds allow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from .search import DAY_MIN, candidate_stops, judged
from .trips import Day, _arrays, plan, worth

#: Candidates of a zone, best value a minute first; zones of a question that the first round plans; when days begin.
CANDIDATES, FIRST, START = 40, 4, 8 * 60


def candidates(good: DataFrame, stops: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The best stops of each (query, zone), by value a minute, with their value: the rank, halved where the stop serves
    none of the interests that the question has."""
    s = stops.withColumnsRenamed({"interests": "_serves", "rank": "_rank"})
    c = candidate_stops(good.select("query", "zone", "base_lat", "base_lon", "max_altitude", "interests", "visit_minutes"), s)
    wanted = (F.size("interests") == 0) | F.arrays_overlap("interests", "_serves")
    c = c.withColumn("value", F.coalesce("_rank", F.lit(1)) * F.when(wanted, 1.0).otherwise(0.5))
    best = Window.partitionBy("query", "zone").orderBy((F.col("value") / F.greatest("visit", F.lit(1))).desc(), "stop")
    return c.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)


def bounds(c: DataFrame) -> DataFrame:
    """(query, zone, bound): no plan of the zone is worth more. Visits fill the minutes in the order of value a minute, the
    last one in part; ways, waits and repeated kinds only take away from that."""
    w = Window.partitionBy("query", "zone").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    used = c.withColumn("_used", F.sum("visit").over(w))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("visit_minutes") - F.col("_used") + F.col("visit")) / F.greatest("visit", F.lit(1))))
    return used.groupBy("query", "zone").agg(F.sum(F.col("value") * part).alias("bound"))


def _planned(g: pd.DataFrame) -> pd.DataFrame:
    """One zone's plan for one question: whole days, and what minutes are left as one more."""
    left = int(g["visit_minutes"].iloc[0])
    limits = [DAY_MIN] * (left // DAY_MIN) + ([left % DAY_MIN] if left % DAY_MIN else [])
    names, d, value, kind = _arrays(g, START, DAY_MIN)
    days = [Day(START, n, d.travel, d.visit, d.opens, d.closes) for n in limits]
    routes = plan(days, value, kind)
    return pd.DataFrame({"query": [g["query"].iloc[0]], "zone": [g["zone"].iloc[0]], "value": [worth(routes, value, kind)], "routes": [[[names[s - 1] for s in r] for r in routes]]})


def planned_trips(queries: DataFrame, zones: DataFrame, access: DataFrame, stops: DataFrame, season: DataFrame, best: int = 3, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(trips, work). trips: per question its best, at most one a base, by value of the planned days times the season's
    factor, then zone: (query, place, zone, base, score, routes). work: (query, zones, planned), of how many zones that can
    be gone to how many were planned.

    zones, stops and season as for search.trips(), zones with base_lat and base_lon, stops with lat, lon, opens, closes
    and kind. Zones are planned by their bounds, a few at first and twice as many each round. Once a question has `best`
    bases, zones whose bound is under the last one's score are left out: what comes out is what planning all would give.
    A zone and question is one group, of CANDIDATES stops at most. Zones whose plan holds nothing are not offered.
    """
    good = judged(queries, zones, access, stops).where("reason IS NULL")
    c = materialised(candidates(good, stops), "candidates")
    f = season.withColumnsRenamed({"zone": "_z", "month": "_m"})
    ahead = good.select("query", "zone", "base", "month").join(bounds(c), ["query", "zone"]).join(f, (F.col("zone") == F.col("_z")) & (F.col("month") == F.col("_m"))).withColumn("bound", F.col("bound") * F.col("factor"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "zone"))
    ahead = materialised(ahead.select("query", "zone", "base", "factor", "bound", rank.alias("rank")), "bounds")
    kind = "query long, zone long, value double, routes array<array<long>>"
    done, low, high = None, 0, first
    while True:
        rows = ahead.where(F.col("rank") > low)
        if done is not None:
            per_base = done.groupBy("query", "base").agg(F.max("score").alias("score"))
            place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
            last = per_base.withColumn("_n", place).where(F.col("_n") == best).select("query", F.col("score").alias("least"))
            rows = materialised(rows.join(last, "query", "left").where("least IS NULL OR bound >= least - 1e-6").drop("least"), "left")
            if rows.isEmpty():
                break
        now = rows.where(F.col("rank") <= high)
        plans = c.join(now.select("query", "zone"), ["query", "zone"]).groupBy("query", "zone").applyInPandas(_planned, kind)
        score = F.round(F.col("value") * F.col("factor"), 6)
        plans = materialised(plans.join(now.select("query", "zone", "base", "factor"), ["query", "zone"]).select("query", "zone", "base", score.alias("score"), "routes"), "plans")
        done = plans if done is None else done.unionByName(plans)
        low, high = high, 2 * high
    offered = done.where("exists(routes, r -> size(r) > 0)")
    per_base = Window.partitionBy("query", "base").orderBy(F.desc("score"), "zone")
    top = offered.withColumn("_b", F.row_number().over(per_base)).where("_b = 1")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "zone"))
    trips = top.withColumn("place", place).where(F.col("place") <= best).select("query", "place", "zone", "base", "score", "routes")
    work = ahead.groupBy("query").agg(F.count(F.lit(1)).alias("zones")).join(done.groupBy("query").agg(F.count(F.lit(1)).alias("planned")), "query", "left").fillna(0, ["planned"])
    return trips, work
