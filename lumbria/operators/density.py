"""Density clusters of places: a spanning tree over mutual reachability, and the clusters that last longest in it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RADIUS_KM
from ..session import materialised
from .components import connected_components
from .joins import bounded_km, nearest, radius_join


def reachability(points: DataFrame, km: float, neighbours: int) -> DataFrame:
    """(a, b, w), a < b, for all pairs of points (id, lat, lon) within km: the largest of their distance and both core
    distances. A point's core distance is that to its `neighbours`-th nearest, itself the first; without as many within
    km it has none, and no pairs."""
    p = points.select("id", "lat", "lon")
    near = materialised(radius_join(p, p.withColumnRenamed("id", "other"), km).where("id <> other").select("id", "other", "km"), "near")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("km", "other"))
    core = p.select("id", F.lit(0.0).alias("core")) if neighbours <= 1 else near.withColumn("_n", nth).where(F.col("_n") == neighbours - 1).select("id", F.col("km").alias("core"))
    core = materialised(core, "core")
    at = lambda x: core.withColumnsRenamed({"id": x, "core": f"core_{x}"})
    e = near.where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), "km")
    return e.join(at("a"), "a").join(at("b"), "b").select("a", "b", F.greatest("km", "core_a", "core_b").alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, w), a < b, of the least spanning forest; of equal weights those with the smaller ends.

    Borůvka's rounds: each part takes its least edge out, and what they join is one part in the next round, so their
    number falls by half at least. Edges within a part are dropped as they arise. A round is joins and a minimum a part.
    Edges may bring the parts of their ends, pa and pb, that lighter edges have joined before."""
    known = [F.col("pa"), F.col("pb")] if "pa" in edges.columns else [F.col("a").alias("pa"), F.col("b").alias("pb")]
    left = materialised(edges.select("a", "b", "w", *known), "edges")
    tree = None
    while not left.isEmpty():
        ends = left.select(F.col("pa").alias("p"), "w", "a", "b", F.col("pb").alias("q")).unionByName(left.select(F.col("pb").alias("p"), "w", "a", "b", F.col("pa").alias("q")))
        least = materialised(ends.groupBy("p").agg(F.min(F.struct("w", "a", "b", "q")).alias("e")).select("p", "e.*"), "least")
        new = least.select("a", "b", "w").distinct()
        tree = new if tree is None else tree.unionByName(new)
        parts = materialised(connected_components(least.select(F.col("p").alias("src"), F.col("q").alias("dst"))), "parts")
        of = lambda p: parts.select(F.col("node").alias(p), F.col("component").alias(f"new_{p}"))  # noqa: E731, B023
        moved = left.join(of("pa"), "pa", "left").join(of("pb"), "pb", "left")
        left = materialised(moved.select("a", "b", "w", F.coalesce("new_pa", "pa").alias("pa"), F.coalesce("new_pb", "pb").alias("pb")).where("pa <> pb"), "edges")
    return edges.select("a", "b", "w").limit(0) if tree is None else materialised(tree, "tree")


def _sites(points: DataFrame) -> DataFrame:
    """(id, n, lat, lon): places that have points (id, lat, lon), the smallest id of each and how many ids there are."""
    p = points.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(double(lat)) AND NOT isnan(double(lon))").select("id", "lat", "lon").distinct()
    return materialised(p.groupBy("lat", "lon").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "n", "lat", "lon"), "sites")


def near_forest(sites: DataFrame, km: float) -> DataFrame:
    """(a, b, w), a < b, of the least spanning forest of sites (id, lat, lon, core) at most km apart, of weights
    max(distance, core of a, core of b), cores at most km.

    Rings: edges of up to r are settled before any longer one is looked at, and r grows fourfold. In a ring only sites with one of
    another part in the cells around them are compared, so where all are joined by short edges no long one is ever made."""
    cores = lambda x: F.col("core").alias(f"core_{x}")
    plain = sites.select("id", "lat", "lon")
    r = bounded_km(plain, plain, km, 64.0)
    part = materialised(sites.select("id", "lat", "lon", "core", F.col("id").alias("part")), "part")
    tree = None
    while True:
        left = part if tree is None else _mixed(part, r)
        a = left.select(F.col("id").alias("a"), "lat", "lon", cores("a"), F.col("part").alias("pa"))
        b = left.select(F.col("id").alias("b"), "lat", "lon", cores("b"), F.col("part").alias("pb"))
        e = radius_join(a, b, r).where("a < b AND pa <> pb").withColumn("w", F.greatest("km", "core_a", "core_b")).where(F.col("w") <= r)
        new = spanning_forest(e.select("a", "b", "w", "pa", "pb"))
        tree = new if tree is None else materialised(tree.unionByName(new), "tree")
        if r >= km:
            return tree
        of = connected_components(tree, "a", "b").select(F.col("node").alias("id"), "component")
        part = materialised(part.drop("part").join(of, "id", "left").select("id", "lat", "lon", "core", F.coalesce("component", "id").alias("part")), "part")
        if part.select("part").distinct().limit(2).count() < 2:
            return tree
        r = min(4 * r, km)


def _mixed(part: DataFrame, km: float) -> DataFrame:
    """Those of part (id, lat, lon, part) that have one of another part in their cell or one beside it, and any within km."""
    step = math.degrees(km / RADIUS_KM) * 1.0001
    far = part.agg(F.max(F.abs("lat"))).first()[0]
    wide = step / max(math.cos(math.radians(min(90.0, far + step))), 1e-12)
    n = max(1, int(360 / wide)) if wide < 360 else 1
    y, x = F.floor((F.col("lat") + 90) / step), F.pmod(F.floor((F.col("lon") + 180) * n / 360), F.lit(n))
    placed = part.withColumns({"_y": y, "_x": x})
    cells = materialised(placed.groupBy("_y", "_x").agg(F.min("part").alias("low"), F.max("part").alias("high")), "cells")
    dy, dx = (F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias(k) for k in ("dy", "dx"))
    around = cells.select("*", dy).select("*", dx).groupBy((F.col("_y") + F.col("dy")).alias("_y"), F.pmod(F.col("_x") + F.col("dx"), F.lit(n)).alias("_x")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return placed.join(around.where("low <> high").select("_y", "_x"), ["_y", "_x"], "left_semi").drop("_y", "_x")


def radius_components(points: DataFrame, km: float) -> DataFrame:
    """(node, component): parts of points (id, lat, lon) that steps of at most km join, named by their smallest id. A point
    without coordinates is a part of its own."""
    sites = _sites(points).select("id", "lat", "lon")
    r, part, ring = bounded_km(sites, sites, km, 64.0), sites.withColumn("part", F.col("id")), 0
    while True:
        left = _mixed(part, r) if ring else part
        e = radius_join(left.select(F.col("part").alias("pa"), "lat", "lon"), left.select(F.col("part").alias("pb"), "lat", "lon"), r).where("pa < pb").select("pa", "pb").distinct()
        of = connected_components(materialised(e, "links"), "pa", "pb").withColumnRenamed("node", "part")
        part = materialised(part.join(of, "part", "left").select("id", "lat", "lon", F.coalesce("component", "part").alias("part")), "part")
        if r >= km or part.select("part").distinct().limit(2).count() < 2:
            break
        r, ring = min(4 * r, km), ring + 1
    named = part.select("lat", "lon", F.col("part").alias("component"))
    return points.select("id", "lat", "lon").distinct().join(named, ["lat", "lon"], "left").groupBy(F.col("id").alias("node")).agg(F.min(F.coalesce("component", "id")).alias("component"))


def _levels(rows: pd.DataFrame) -> tuple[list[tuple[float, list[int], int]], list[int]]:
    """The tree of merges, nodes (weight, children, points) with the root last, and the ids of its leaves, the first nodes;
    edges of one weight merge at once, whatever their order."""
    ids = sorted({*rows["a"], *rows["b"]})
    nodes: list[tuple[float, list[int], int]] = [(0.0, [], 1) for _ in ids]
    leaf = {i: k for k, i in enumerate(ids)}
    up = list(range(len(ids)))
    top = list(range(len(ids)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    order = np.argsort(rows["w"].to_numpy(), kind="stable")
    edges = list(zip(rows["w"].to_numpy()[order].tolist(), rows["a"].to_numpy()[order].tolist(), rows["b"].to_numpy()[order].tolist(), strict=True))
    for w, own in groupby(edges, key=lambda e: e[0]):
        touched: dict[int, list[int]] = {}
        for _, a, b in own:
            x, y = root(leaf[a]), root(leaf[b])
            if x != y:
                mine, other = touched.pop(x, None) or [top[x]], touched.pop(y, None) or [top[y]]
                if len(mine) < len(other):
                    x, y, mine, other = y, x, other, mine
                up[y] = x
                mine += other
                touched[x] = mine
        for r, children in touched.items():
            nodes.append((float(w), sorted(children), sum(nodes[c][2] for c in children)))
            top[r] = len(nodes) - 1
    return nodes, ids


def lasting(rows: pd.DataFrame, least: int, km: float) -> dict[int, int]:
    """Cluster of each id of one part of the forest, named by its smallest id; ids of no cluster are left out.

    From the heaviest edges down, a cluster of `least` points or more either loses points, or parts into two or more
    clusters of that size. Each lasts from where it arises until its points have left it, in 1 / weight, summed over
    them; a cluster stands if it outlasts what its parts, and theirs, come to together."""
    nodes, ids = _levels(rows)
    top = len(nodes) - 1
    sharp = lambda w: 1 / max(w, 1e-9)
    clusters: list[dict] = []

    def below(k: int) -> Iterator[int]:
        todo = [k]
        while todo:
            x = todo.pop()
            if not nodes[x][1]:
                yield ids[x]
            todo.extend(nodes[x][1])

    todo = [(top, sharp(km), None)] if nodes[top][2] >= least else []
    while todo:
        k, born, parent = todo.pop()
        me = {"node": k, "stays": 0.0, "parts": [], "on": True}
        clusters.append(me)
        if parent is not None:
            parent["parts"].append(me)
        while True:
            w, children, size = nodes[k]
            big = [c for c in children if nodes[c][2] >= least]
            if len(big) == 1:
                me["stays"] += (size - nodes[big[0]][2]) * (sharp(w) - born)
                k = big[0]
                continue
            me["stays"] += size * (sharp(w) - born)
            todo += [(c, sharp(w), me) for c in big]
            break
    out: dict[int, int] = {}
    for me in reversed(clusters):  # parts come after what they are parts of
        inner = sum(p["worth"] for p in me["parts"])
        me["on"] = me["stays"] >= inner
        me["worth"] = max(me["stays"], inner)
    hidden: set[int] = set()
    for me in clusters:
        if id(me) in hidden or me["on"]:
            hidden.update(id(p) for p in me["parts"])
            if id(me) not in hidden:
                own = list(below(me["node"]))
                out.update(dict.fromkeys(own, min(own)))
    return out


def density_clusters(points: DataFrame, km: float, neighbours: int = 5, least: int = 5) -> DataFrame:
    """(id, cluster) for each of points (id, lat, lon): hierarchical density clusters of `least` points or more, named by
    their smallest id, null for noise.

    Points of one place are equally far from all others and from each other no farther than its core, so places with their
    numbers of points are compared, and the points of a place are joined to its first at that core.

    Places over km apart are taken for apart, which cuts the hierarchy there: each part of the forest within km is a
    cluster that may stand or part further. Pairs, cores and the forest are Spark joins; a part's own tree of merges, one
    edge a point, is one task. Repeated ids are one place each if equal; a place without coordinates is noise."""
    sites = _sites(points)
    other = sites.select(F.col("id").alias("other"), F.col("n").alias("ids"), "lat", "lon")
    near = nearest(sites.select("id", "lat", "lon"), other, ["id"], ["other"], km, max(neighbours, 1))
    seen = near.withColumn("_seen", F.sum("ids").over(Window.partitionBy("id").orderBy("km", "other").rowsBetween(Window.unboundedPreceding, 0)))
    core = seen.where(F.col("_seen") >= neighbours).groupBy("id").agg(F.min("km").alias("core"))
    dense = materialised(sites.join(core, "id"), "dense")
    forest = near_forest(dense, km)
    part = connected_components(forest, "a", "b")
    dense = materialised(dense.join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component"), "dense")
    same = points.select(F.col("id").alias("b"), "lat", "lon").distinct().join(dense.select(F.col("id").alias("a"), "lat", "lon", F.col("core").alias("w"), "part"), ["lat", "lon"]).where("a < b")
    rows = forest.join(dense.select(F.col("id").alias("a"), "part"), "a").select("a", "b", "w", "part").unionByName(same.select("a", "b", "w", "part"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        found = lasting(g, least, km)
        return pd.DataFrame({"id": list(found), "cluster": list(found.values())})

    found = rows.groupBy("part").applyInPandas(one, "id long, cluster long")
    return points.select("id").distinct().join(found, "id", "left")
