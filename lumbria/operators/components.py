"""Connected components of edges that only the cluster can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges; a component is named by its smallest node.

    Alternating large-star and small-star rounds (Kiveris and others, 2014) until nothing changes: each round links a
    node to the smallest of its neighbourhood, so a chain shrinks by a constant factor a round and a star stays one.
    Each round is written to the shared folder; nothing but two sums reaches the driver. Self-links name lone nodes.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = materialised(both.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    e = materialised(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        e = _star(e, large=True)
        e = materialised(_star(e, large=False), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours link to its smallest neighbour or itself. Small star: the node and its
    smaller neighbours do. e holds (u, v) with u > v."""
    around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
    low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()
