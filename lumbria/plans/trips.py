"""Networks, day plans, cost bands and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network as nw, optimum as op, trips as tr
from ..streaming import log as st
from .places import _LAT, _LON, _SQL, _hav, customers, suppliers
from .relational import T

c = F.col


def _edges(s, d):
    n = T(s, d, "nation").select(c("n_nationkey").cast("long").alias("u"))
    out = n.select("u", F.explode(F.expr("array(named_struct('v', (u * 3 + 1) % 25, 'w', u % 7 + 1), named_struct('v', (u + 5) % 25, 'w', u % 5 + 3), named_struct('v', (u * 2) % 23, 'w', 9))")).alias("e"))
    return out.select("u", c("e.v").alias("v"), c("e.w").cast("double").alias("cost")).where("u <> v")


_EDGES = "e AS (SELECT u, v, min(w)::DOUBLE AS w FROM (SELECT n_nationkey::BIGINT AS u, unnest([(n_nationkey * 3 + 1) % 25, (n_nationkey + 5) % 25, (n_nationkey * 2) % 23])::BIGINT AS v, unnest([n_nationkey % 7 + 1, n_nationkey % 5 + 3, 9]) AS w FROM nation) WHERE u <> v GROUP BY ALL), d0 AS (SELECT * FROM e UNION ALL SELECT n_nationkey, n_nationkey, 0 FROM nation)"
_DOUBLED = ", ".join(f"d{k + 1} AS (SELECT u, v, min(w) AS w FROM (SELECT a.u, b.v, a.w + b.w AS w FROM d{k} a JOIN d{k} b ON a.v = b.u) GROUP BY ALL)" for k in range(5))


def _ways(s, d):
    return T(s, d, "lineitem").select(c("l_orderkey").alias("way"), F.row_number().over(nw.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("seq"), c("l_suppkey").alias("node")).dropDuplicates(["way", "node"]).select("way", "seq", "node", F.expr(_LAT.format(k="node")).alias("lat"), F.expr(_LON.format(k="node")).alias("lon"))


def _stops(s, d):
    """All customers, ten ids a trip."""
    p = customers(s, d).withColumn("trip", F.expr("id div 10").cast("long"))
    lat, lon = -12.0 + (c("id") % 13) * 0.02, -77.0 + (c("id") % 7) * 0.03
    return p.select("trip", c("id").alias("stop"), lat.alias("lat"), lon.alias("lon"), F.lit(-12.0).alias("base_lat"), F.lit(-77.0).alias("base_lon"), (30 + (c("id") * 7) % 90).cast("double").alias("visit"), ((c("id") % 3) * 120 + 360).cast("double").alias("opens"), (960 + (c("id") % 4) * 60).cast("double").alias("closes"), (1 + (c("id") * 11) % 24).cast("double").alias("value"), c("c_mktsegment").alias("kind"), (1 + c("trip") % 3).cast("int").alias("days"))


def _costs(s, d):
    t = T(s, d, "orders").select("o_orderkey", (c("o_orderkey") % 900).cast("double").alias("km"), (c("o_orderkey") % 6).cast("double").alias("nights"), (c("o_orderkey") % 6 + 1).cast("double").alias("days"))
    return tr.cost_bands(t, {"km": (0.08, 0.14), "night": (45, 110), "day": (25, 60)}, {"km": "km", "night": "nights", "day": "days"})


def _events(s, d):
    """The events table as a stream; event time needs a zone."""
    e = T(s, d, "events")
    return st.landed(e.withColumn("ts", c("ts").cast("timestamp")), "events")


def _dedup(s, d):
    """Every third event is sent again, an hour later by the sender's clock, and lands among the others."""
    e = T(s, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    again = e.where("event_id % 3 = 0").withColumn("ts", c("ts") + F.expr("INTERVAL 1 HOUR"))
    return st.run_once(st.ingested(st.landed(e.unionByName(again), "events")), "ingest").select("event_id", "event_type")


def _limited(s, d):
    e = _events(s, d).select("event_id", "user_id", "ts")
    return st.run_once(st.rate_limited(e, "user_id", "ts", 3, 86_400, "event_id long, user_id long, ts timestamp"), "limited").select("event_id", "user_id")


def _counts(s, d):
    return st.run_once(st.running_counts(_events(s, d), "event_type", "ts"), "counts", "complete").withColumn("start", c("start").cast("timestamp_ntz"))


def _latest(s, d):
    return st.upsert(_events(s, d).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "latest").withColumn("ts", c("ts").cast("timestamp_ntz"))


QUERIES = {
    "G1_split_ways": (lambda s, d: nw.split_ways(_ways(s, d)).select("way", "segment", "u", "v", F.round("km", 6).alias("km")), None),
    "G2_transfer_edges": (lambda s, d: nw.transfer_edges(suppliers(s, d).withColumnRenamed("s_id", "id"), customers(s, d), 60).select("u", "v", F.round("km", 6).alias("km")), f"{_SQL}, p AS (SELECT s.s_id AS u, c.id AS v, {_hav('s.r_lat', 's.r_lon', 'c.lat', 'c.lon')} AS km FROM c, s), q AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY km, v) AS r FROM p WHERE km <= 60) SELECT u, v, round(km, 6) AS km FROM q WHERE r = 1 UNION ALL SELECT v, u, round(km, 6) FROM q WHERE r = 1"),
    "G3_edge_minutes": (lambda s, d: nw.edge_minutes(T(s, d, "lineitem").select("l_orderkey", "l_partkey", c("l_returnflag").alias("kind"), (c("l_quantity")).alias("km"), (c("l_partkey") % 2 == 0).alias("unpaved"), (c("l_suppkey") % 3).cast("double").alias("turns"), (c("l_suppkey") % 4 == 0).alias("town")), s.createDataFrame([("A", 1.0), ("N", 1.5), ("R", 2.0)], "kind string, pace double"), 0.5, 0.125, 2.5).select("l_orderkey", "l_partkey", "minutes"), "SELECT l_orderkey, l_partkey, l_quantity * CASE WHEN l_suppkey % 4 = 0 THEN greatest(r, 2.5::DOUBLE) ELSE r END AS minutes FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 1.5::DOUBLE ELSE 2.0::DOUBLE END + CASE WHEN l_partkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END + (l_suppkey % 3) * 0.125::DOUBLE AS r FROM lineitem)"),
    "G4_parallel_edges": (lambda s, d: nw.cheapest_parallel(T(s, d, "lineitem").select((c("l_partkey") % 50).alias("u"), (c("l_suppkey") % 50).alias("v"), c("l_extendedprice").alias("minutes"))), "SELECT l_partkey % 50 AS u, l_suppkey % 50 AS v, min(l_extendedprice) AS minutes FROM lineitem GROUP BY ALL"),
    "G7_paths_with_retry": (lambda s, d: nw.paths_with_retry(_edges(s, d).select("*", (c("cost") * 2).alias("km"), ((c("u") + c("v")) % 3 > 0).alias("inside")), T(s, d, "nation").select(c("n_nationkey").cast("long").alias("source"), F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 7, 13, 24)))).alias("node")), "inside", ("km",)).select("source", "node", (c("km") == 2 * c("cost")).alias("fits")), "SELECT n_nationkey::BIGINT AS source, unnest([1, 7, 13, 24])::BIGINT AS node, true AS fits FROM nation"),
    "G7_shortest_paths": (lambda s, d: nw.shortest_paths(_edges(s, d), T(s, d, "nation").select(c("n_nationkey").cast("long").alias("source"), c("n_nationkey").cast("long").alias("node"))), f"WITH {_EDGES}, {_DOUBLED} SELECT u AS source, v AS node, w AS cost FROM d5"),
    "G9_town_cells": (lambda s, d: nw.town_cells(customers(s, d), 1.0, 6.0).select(c("y").cast("int").alias("y"), c("x").cast("int").alias("x"), F.round("density", 6).alias("density")), f"{_SQL}, n AS (SELECT CAST(floor(lat) AS INT) AS y, CAST(floor(lon) AS INT) AS x, count(*) AS n FROM c GROUP BY ALL), o AS (SELECT unnest([-1, 0, 1]) AS k) SELECT y + p.k AS y, x + q.k AS x, round(sum(n) / 9, 6) AS density FROM n, o p, o q GROUP BY 1, 2 HAVING sum(n) / 9 >= 6"),
    "G14_day_plans": (lambda s, d: tr.day_plans(_stops(s, d)), None),
    "G16_exact_day": (lambda s, d: tr.exact_day(_stops(s, d)), None),
    "G16_exact_plans": (lambda s, d: op.exact_plans(_stops(s, d)).select("trip", F.round("best", 6).alias("best"), F.round("bound", 6).alias("bound"), F.expr("aggregate(routes, 0L, (n, r) -> n + size(r))").alias("stops")), None),
    "G18_visiting_orders": (lambda s, d: tr.visiting_orders(_stops(s, d)), None),
    "G19_cost_bands": (_costs, None),
    "ST1_received": (lambda s, d: st.run_once(st.received(_events(s, d)), "received").select("event_id", (F.abs(F.unix_timestamp("received") - F.unix_timestamp(F.current_timestamp())) < 3600).alias("now")), "SELECT event_id, true AS now FROM events"),
    "ST8_in_order": (lambda s, d: st.in_order(st.run_once(_events(s, d), "order"), "user_id", "ts", "event_id").select("user_id", "event_id", "place"), "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('microsecond', ts), event_id) AS INT) AS place FROM events"),
    "S13_expiry": (lambda s, d: T(s, d, "orders").where(F.expr("TIMESTAMP '1997-01-01'") < st.expires("o_orderdate")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) + 2 > DATE '1997-01-01'"),
    "ST2_idempotent_ingest": (_dedup, "SELECT event_id, event_type FROM events"),
    "ST3_rate_limit": (_limited, None),
    "ST4_running_counts": (_counts, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "ST6_upsert": (_latest, "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"),
}
