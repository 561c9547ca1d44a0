"""Reports over proposals, budgets, rules and a business: grouped counts and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(proposals: DataFrame, questions: DataFrame, top: int = 10) -> DataFrame:
    """One row over proposals (query, zone, origin): questions with three, two, one and no trips, trips, distinct zones, the
    median of distinct zones an origin, and the share of trips that the `top` zones most proposed take."""
    n = questions.select("query").distinct().join(proposals.groupBy("query").agg(F.count(F.lit(1)).alias("n")), "query", "left").fillna(0, ["n"])
    by_count = n.agg(*(F.count_if(F.col("n") == k).alias(f"with_{k}") for k in (3, 2, 1, 0)))
    zones = proposals.groupBy("zone").agg(F.count(F.lit(1)).alias("k"))
    leading = zones.orderBy(F.col("k").desc(), "zone").limit(top).agg(F.sum("k").alias("_top"))
    total = zones.agg(F.sum("k").alias("trips"), F.count(F.lit(1)).alias("zones"))
    per_origin = proposals.groupBy("origin").agg(F.count_distinct("zone").alias("z")).agg(F.percentile("z", F.lit(0.5)).alias("zones_an_origin"))
    one = by_count.crossJoin(total).crossJoin(leading).crossJoin(per_origin)  # four tables of one row
    return one.withColumn("top_share", F.col("_top") * 100.0 / F.col("trips")).drop("_top")


def profit_and_loss(sales: DataFrame, by: list[str], fixed: float) -> DataFrame:
    """Per group: revenue, variable cost, marketing and contribution; the whole has the fixed cost and the profit as well.

    sales: (revenue, variable, marketing, ...). Fixed cost isn't shared out: a filtered or grouped view has none of it.
    Rows of the whole have null groups.
    """
    sums = (F.sum("revenue").alias("revenue"), F.sum("variable").alias("variable"), F.sum("marketing").alias("marketing"))
    g = sales.rollup(*by).agg(F.grouping_id().alias("_level"), *sums) if by else sales.agg(F.lit(0).alias("_level"), *sums)
    whole = F.col("_level") == (1 << len(by)) - 1
    g = g.where(whole | (F.col("_level") == 0)).withColumn("contribution", F.col("revenue") - F.col("variable") - F.col("marketing"))
    return g.withColumn("fixed", F.when(whole, F.lit(fixed))).withColumn("profit", F.when(whole, F.col("contribution") - fixed)).drop("_level")


def budget_criteria(chosen: DataFrame, base: str = "today") -> DataFrame:
    """How other criteria would change what is proposed: per group and criterion the questions, trips proposed, those over
    budget in the middle and in a dear case and those over in the dear case alone, and how many questions change, lose
    trips or lose all.

    chosen: (group, query, criterion, place, zone, p50, p80, budget), a row per trip.
    """
    per = chosen.groupBy("group", "query", "criterion").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "zone"))), lambda x: x["zone"].cast("string")), ",").alias("zones"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("p50") > F.col("budget")).alias("over_p50"),
        F.count_if(F.col("p80") > F.col("budget")).alias("over_p80"),
        F.count_if((F.col("p50") <= F.col("budget")) & (F.col("p80") > F.col("budget"))).alias("only_p80"),
    )
    criteria = chosen.select("criterion").distinct()
    now = per.where(F.col("criterion") == base).select("group", "query", F.col("zones").alias("_z"), F.col("n").alias("_n"))
    # Questions by criteria: both are small, stated sets.
    grid = per.select("group", "query").distinct().join(F.broadcast(criteria)).join(per, ["group", "query", "criterion"], "left").join(now, ["group", "query"], "left")
    n, before = F.coalesce("n", F.lit(0)), F.coalesce("_n", F.lit(0))
    return grid.groupBy("group", "criterion").agg(
        F.count(F.lit(1)).alias("questions"),
        F.sum(n).alias("trips"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("over_p50", "over_p80", "only_p80")),
        F.count_if(F.coalesce("zones", F.lit("")) != F.coalesce("_z", F.lit(""))).alias("changed"),
        F.count_if(n < before).alias("fewer"),
        F.count_if((n == 0) & (before > 0)).alias("none"),
    )


def rule_agreement(found: DataFrame, truth: DataFrame, key: str, value: str) -> DataFrame:
    """What a rule finds against annotated rows: right, wrong, missed, invented, precision and recall.

    found and truth: (key, value), null where there is nothing to find; rows that aren't annotated don't count.
    """
    t, f = F.col("_truth"), F.col("_found")
    j = truth.select(key, F.col(value).alias("_truth")).join(found.select(key, F.col(value).alias("_found")), key, "left")
    c = j.agg(
        F.count_if(t == f).alias("right"),
        F.count_if((t != f) & t.isNotNull() & f.isNotNull()).alias("wrong"),
        F.count_if(t.isNotNull() & f.isNull()).alias("missed"),
        F.count_if(t.isNull() & f.isNotNull()).alias("invented"),
    )
    r = F.col("right")
    return c.withColumn("precision", F.try_divide(r * 1.0, r + F.col("wrong") + F.col("invented"))).withColumn("recall", F.try_divide(r * 1.0, r + F.col("wrong") + F.col("missed")))


def sensitivity(trips: DataFrame, ranges: dict[str, tuple[float, float]], amounts: dict[str, str]) -> DataFrame:
    """Per parameter the mean cost of a trip with it at either end of its range and all others in the middle, and the swing.

    amounts: parameter -> the column that it is taken times.
    """
    mid = {n: (a + b) / 2 for n, (a, b) in ranges.items()}
    sums = trips.agg(F.count(F.lit(1)).alias("_n"), *(F.sum(F.col(c).cast("double")).alias(n) for n, c in amounts.items()))
    cost = lambda own, price: sum((F.lit(price if n == own else mid[n]) * F.col(n) for n in amounts), F.lit(0.0)) / F.col("_n")
    rows = F.array(*(F.struct(F.lit(n).alias("parameter"), cost(n, a).alias("low"), cost(n, b).alias("high")) for n, (a, b) in ranges.items()))
    return sums.select(F.explode(rows).alias("r")).select("r.*").withColumn("swing", F.col("high") - F.col("low"))


def blind_kit(proposals: DataFrame, seed: str, question: str = "query", option: str = "zone", system: str = "system") -> DataFrame:
    """(question, place, option, systems): what any system proposes for a question, once each, in an order that only the
    seed decides, so that a rater can't tell whose it is; systems is the key to keep apart."""
    u = proposals.groupBy(question, option).agg(F.array_sort(F.collect_set(system)).alias("systems"))
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.col(question).cast("string"), F.col(option).cast("string")))
    return u.withColumn("place", F.row_number().over(Window.partitionBy(question).orderBy(mark, option)))


def system_coverage(proposals: DataFrame, zones: DataFrame, system: str = "system") -> DataFrame:
    """Per system: proposals, distinct zones, their share of all zones, share off the circuit and mean novelty.

    proposals: (system, query, zone); zones: (zone, off_circuit, novelty)."""
    total = zones.agg(F.count(F.lit(1)).alias("_all"))
    p = proposals.join(zones, "zone").groupBy(system).agg(
        F.count(F.lit(1)).alias("proposals"), F.count_distinct("zone").alias("zones"), F.avg(F.col("off_circuit").cast("double")).alias("off_circuit"), F.avg("novelty").alias("novelty")
    )
    return p.crossJoin(F.broadcast(total)).withColumn("share", F.col("zones") / F.col("_all")).drop("_all")


def shared_zones(proposals: DataFrame, system: str = "system") -> DataFrame:
    """(a, b, both, any): zones that two systems both propose, and that either does; systems are few."""
    z = proposals.groupBy(system).agg(F.collect_set("zone").alias("z"))
    a, b = z.select(F.col(system).alias("a"), F.col("z").alias("x")), z.select(F.col(system).alias("b"), F.col("z").alias("y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), F.size(F.array_union("x", "y")).alias("any"))
