"""The versioned table over the given tables: puts, deletions, scans, reading since a version, a bound on rows to come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..streaming import log as st
from ..streaming.versions import Reader, Versioned
from .relational import T

c = F.col

#: Day from which the ends of orders lie ahead, and orders ahead that the table takes.
TODAY, AHEAD = "1997-01-01", 500


def _users(s: SparkSession, d: str) -> tuple[Versioned, DataFrame]:
    e = T(s, d, "events").select("user_id", "event_id", "event_type", (c("event_id") % 4).alias("part"))
    return Versioned(s, scratch(s, "users"), e.drop("part").schema, ["user_id"]), e


def _last(e: DataFrame) -> DataFrame:
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("e")).select("user_id", "e.*")


def _since(s: SparkSession, d: str) -> DataFrame:
    """Each quarter of the events is a version; what a reader that stopped at the second has to read."""
    table, e = _users(s, d)
    for k in range(4):
        table.put(_last(e.where(c("part") == k)))
    return table.since(2).select("user_id", "event_id", "event_type")


def _marked(s: SparkSession, d: str) -> DataFrame:
    """A stream of the events put batch by batch; the reader sees the last version. A user's batches come in any order, so
    only who is there is compared, and the marker."""
    table, e = _users(s, d)
    table.follow(st.landed(e.drop("part"), "users", 4, 1), scratch(s, "users-state"))
    version, rows = Reader(table).current()
    return rows.select("user_id", F.lit(version).alias("version"))


def _scanned(s: SparkSession, d: str) -> DataFrame:
    """Orders put, every third corrected, every seventh deleted, a snapshot taken in between."""
    o = T(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = Versioned(s, scratch(s, "orders"), o.schema, ["o_orderkey"])
    table.put(o)
    table.put(o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")))
    table.snapshot()
    table.delete(o.where("o_orderkey % 7 = 0").select("o_orderkey"))
    return table.scan()


def _bounded(s: SparkSession, d: str) -> DataFrame:
    """Orders with their dates: of those ahead only AHEAD get in, the earliest first; odd ones come in a second put."""
    o = T(s, d, "orders").select("o_orderkey", c("o_orderdate").cast("date").alias("day"))
    table, ahead = Versioned(s, scratch(s, "bounded"), o.schema, ["o_orderkey"]), c("day") >= F.lit(TODAY).cast("date")
    for k in range(2):
        table.put_some(o.where(c("o_orderkey") % 2 == k), ahead, ["day"], most=AHEAD)
    return table.scan().select("o_orderkey", ahead.alias("ahead"))


QUERIES = {
    "ST5_since_version": (_since, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id DESC) AS r FROM events WHERE event_id % 4 >= 2) WHERE r = 1"),
    "ST5_change_marker": (_marked, "SELECT DISTINCT user_id, 4 AS version FROM events"),
    "S13_put_scan": (_scanned, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0"),
    "ST6_bounded_ahead": (_bounded, f"WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) >= DATE '{TODAY}' AS ahead, CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY ahead ORDER BY o_orderkey % 2, day, o_orderkey) AS n FROM o) SELECT o_orderkey, ahead FROM r WHERE NOT ahead OR n <= {AHEAD}"),
}
