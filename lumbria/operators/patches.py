"""Town patches: dense cells of a network joined where they touch, and the band of each patch by its area."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .components import connected_components

#: Side of a cell in degrees, crossings a km2 from which a cell is town, and km2 from which a patch is of the next band.
CELL, LEAST, BANDS = 0.005, 40.0, (20.0, 100.0, 500.0)
#: Cells of a tile's side: what one task labels at once.
TILE = 256


def crossings(edges: DataFrame) -> DataFrame:
    """(node) where three edges or more meet: undirected, parallel ones and self-links once."""
    pairs = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("node")


def cell_of(lat: Column, lon: Column, size: float) -> list[Column]:
    return [F.floor(lat / size).cast("long").alias("y"), F.floor(lon / size).cast("long").alias("x")]


def cell_km2(y: Column, size: float) -> Column:
    return F.pow(F.lit(size * 111.32), 2) * F.cos(F.radians((y + 0.5) * size))


def dense_cells(points: DataFrame, size: float = CELL, least: float = LEAST) -> DataFrame:
    """(y, x) of the cells whose points (lat, lon) a km2, averaged with the eight cells around, are `least` or more."""
    n = points.groupBy(*cell_of(F.col("lat"), F.col("lon"), size)).agg(F.count(F.lit(1)).alias("n"))
    n = n.select("y", "x", (F.col("n") / cell_km2(F.col("y"), size)).alias("d"))
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    spread = n.withColumn("dy", steps).withColumn("dx", steps).select((F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "d")
    return spread.groupBy("y", "x").agg((F.sum("d") / 9).alias("density")).where(F.col("density") >= least).select("y", "x")


def _labelled(cells: pa.Table) -> pa.Table:
    """The cells of one tile, each with the first cell, by row, then column, of those that it touches within the tile."""
    own = list(zip(cells["y"].to_pylist(), cells["x"].to_pylist(), strict=True))
    up = {c: c for c in own}

    def root(c: tuple[int, int]) -> tuple[int, int]:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    for y, x in own:
        for near in ((y - 1, x - 1), (y - 1, x), (y - 1, x + 1), (y, x - 1)):
            if near in up:
                a, b = sorted((root((y, x)), root(near)))
                up[b] = a
    first = [root(c) for c in own]
    return cells.append_column("ly", pa.array([c[0] for c in first], pa.int64())).append_column("lx", pa.array([c[1] for c in first], pa.int64()))


def patches(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """(y, x, py, px): each of the distinct cells (y, x) with the first cell, by row, then column, of its patch. Cells of a
    patch touch, corners included.

    Cells are joined by union-find within tiles; only cells on a tile's rim look at their neighbours across, and only the
    links between tiles' patches go into star rounds. A patch of any size thus costs a link or so a rim cell.
    """
    c = cells.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).dropna().distinct()
    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    c = materialised(c.withColumn("ty", at("y")).withColumn("tx", at("x")).groupBy("ty", "tx").applyInArrow(_labelled, "y long, x long, ty long, tx long, ly long, lx long"), "tiles")
    name = F.struct(F.col("ly").alias("y"), F.col("lx").alias("x"))
    rim = c.where(f"pmod(y, {tile}) IN (0, {tile - 1}) OR pmod(x, {tile}) IN (0, {tile - 1})").select("y", "x", "ty", "tx", name.alias("name"))
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    around = rim.withColumn("dy", steps).withColumn("dx", steps).select((F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), F.col("ty").alias("oy"), F.col("tx").alias("ox"), F.col("name").alias("other"))
    links = around.join(rim, ["y", "x"]).where("ty <> oy OR tx <> ox").select(F.col("other").alias("src"), F.col("name").alias("dst"))
    joined = connected_components(links)
    return c.withColumn("node", name).join(joined, "node", "left").select("y", "x", F.coalesce("component.y", "ly").alias("py"), F.coalesce("component.x", "lx").alias("px"))


def town_bands(nodes: DataFrame, edges: DataFrame, size: float = CELL, least: float = LEAST, bands: tuple[float, ...] = BANDS, tile: int = TILE) -> DataFrame:
    """(node, py, px, km2, band) for each of nodes (node, lat, lon): its town patch, named by its first cell, the patch's
    area, and how many of the bands it reaches; without a patch null, 0 km2 and band 0. Crossings of edges (u, v) make
    towns; several rows of a node are answered each, and one without a position is in no town."""
    points = crossings(edges).join(nodes.select("node", "lat", "lon").dropna(), "node")
    p = materialised(patches(dense_cells(points, size, least), tile), "patches")
    area = p.groupBy("py", "px").agg(F.sum(cell_km2(F.col("y"), size)).alias("km2"))
    band = sum((F.col("km2") >= b).cast("int") for b in bands)
    named = p.join(area, ["py", "px"]).select("y", "x", "py", "px", "km2", band.alias("band"))
    placed = nodes.select("node", *cell_of(F.col("lat"), F.col("lon"), size))
    return placed.join(named, ["y", "x"], "left").select("node", "py", "px", F.coalesce("km2", F.lit(0.0)).alias("km2"), F.coalesce("band", F.lit(0)).alias("band"))
