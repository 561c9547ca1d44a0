"""What the service answers, as functions from tables to DataFrames; HTTP itself is out of scope.

The trip query is operators.search.trips(), relaxed() and judged(); here are the other answers.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import usage
from .streaming.log import last_writes, received

#: The most days that a question for events may span, and the most events a published list keeps.
EVENT_DAYS, PUBLISHED_MOST = 366, 500
#: Ranges of a question's fields.
DAYS, BUDGET, ALTITUDE = (1, 14), (50, 20_000), (500, 5_500)


class Invalid(ValueError):
    """A field of a question that can't be answered, and why."""

    def __init__(self, field: str, why: str):
        super().__init__(f"{field}: {why}")
        self.field = field


def options(origins: DataFrame, stops: DataFrame) -> DataFrame:
    """(kind, id, label, n): origins, interests with the stops that serve them, and the ranges of the numeric fields."""
    o = origins.select(F.lit("origin").alias("kind"), F.col("origin").cast("string").alias("id"), F.col("name").alias("label"), F.lit(None).cast("long").alias("n"))
    i = stops.select(F.explode("interests").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("interest").alias("kind"), "id", F.col("id").alias("label"), "n")
    ranges = [(f"{name}_{end}", name, v) for name, pair in (("days", DAYS), ("budget", BUDGET), ("max_altitude", ALTITUDE)) for end, v in zip(("min", "max"), pair, strict=True)]
    r = origins.sparkSession.createDataFrame([("range", i, label, v) for i, label, v in ranges], "kind string, id string, label string, n long")
    return o.unionByName(i).unionByName(r)


def zone_sheet(zone: int, zones: DataFrame, stops: DataFrame, seasons: DataFrame, events: DataFrame, first: str) -> DataFrame:
    """One row of a zone: its stops by rank, name and code, its twelve months, and the events of the year from first on.

    stops (stop, zone, rank, name), seasons (zone, month, ...), events (zone, start_date, end_date, name, ...); a zone that
    isn't there gives no row.
    """
    mine = lambda d: d.where(F.col("zone") == zone)
    s = mine(stops).agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("rank", F.lit(0))).alias("by"), "name", "stop"))).alias("_s"))
    m = mine(seasons).agg(F.array_sort(F.collect_list(F.struct("month", *[c for c in seasons.columns if c not in ("zone", "month")]))).alias("months"))
    last = F.date_sub(F.add_months(F.lit(first).cast("date"), 12), 1)
    e = mine(events).where((F.col("start_date") <= last) & (F.col("end_date") >= F.lit(first).cast("date"))).agg(F.array_sort(F.collect_list(F.struct("start_date", "end_date", "name"))).alias("events"))
    one = mine(zones).crossJoin(F.broadcast(s)).crossJoin(F.broadcast(m)).crossJoin(F.broadcast(e))  # rows of one zone
    return one.withColumn("stops", F.transform("_s", lambda x: x["stop"])).drop("_s")


def events_between(events: DataFrame, first: str, last: str, zone: int | None = None) -> DataFrame:
    """Events that share a day with first..last, of a zone or all, by start, end and name; at most EVENT_DAYS days."""
    a, b = datetime.date.fromisoformat(first), datetime.date.fromisoformat(last)
    if b < a:
        raise Invalid("last", "not before first")
    if (b - a).days > EVENT_DAYS:
        raise Invalid("last", f"at most {EVENT_DAYS} days after first")
    d = events.where((F.col("start_date") <= F.lit(b)) & (F.col("end_date") >= F.lit(a)))
    return (d if zone is None else d.where(F.col("zone") == zone)).orderBy("start_date", "end_date", "name")


def published(stored: DataFrame, incoming: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """(kept, refused): stored events with incoming ones published, the last of an id counting, expired ones gone and the
    PUBLISHED_MOST that come next kept; refused ones with why. Rows: (id, name, start_date, end_date, lat, lon, published)."""
    why = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "name"),
            F.when(F.col("start_date").isNull() | F.col("end_date").isNull() | (F.col("end_date") < F.col("start_date")), "dates"),
            F.when(F.col("end_date") < F.lit(today).cast("date"), "past"),
            F.when(F.datediff("end_date", "start_date") > EVENT_DAYS, "too_long"),
            F.when(F.col("lat").isNull() != F.col("lon").isNull(), "place"),
        )
    )
    judged = incoming.withColumn("why", why)
    good = stored.unionByName(judged.where(F.size("why") == 0).select(*stored.columns))
    kept = last_writes(good, ["id"], ["published", "name"]).where(F.date_add("end_date", 2) > F.lit(today).cast("date"))
    return kept.orderBy("start_date", "id").limit(PUBLISHED_MOST), judged.where(F.size("why") > 0)


def logged(events: DataFrame) -> DataFrame:
    """Usage events as they are stored: with the server's time, a retry of an id once."""
    return received(events).dropDuplicates(["event_id"])


def summary(log: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The indicators of the log between two dates, both open."""
    return usage.indicators(usage.between_dates(log, first, last))


def comments(stored: DataFrame, limit: int = 50) -> DataFrame:
    """The newest comments first, each with how many there are in all."""
    n = F.broadcast(stored.agg(F.count(F.lit(1)).alias("total")))
    return stored.crossJoin(n).orderBy(F.col("at").desc(), F.col("id").desc()).limit(limit)


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, ok) of the tables that answers need: a table without rows is not in order."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, d.count()) for name, d in tables.items()]
    return spark.createDataFrame([(n, k, k > 0) for n, k in rows], "name string, rows long, ok boolean")
