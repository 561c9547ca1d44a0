"""Bands of a number: by edges, by closed ranges, by class. Column expressions, so that a lookup never joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Artificial light of a very dark and of a dark sky, as a ratio to the natural one.
VERY_DARK, DARK = 0.3, 2.0
# km2 from which a town is middling, large or a metropolis.
TOWN_KM2 = (20.0, 100.0, 500.0)
# Bands of a way's km.
WAY_KM = (0, 10, 30, 100, 300, 2000)


def _number(value: Column) -> Column:
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def band(value: Column, edges: Sequence[float], from_edge: bool = True) -> Column:
    """How many edges lie at or below the value, or below it only if not from_edge: 0 under the first. Null for null and NaN."""
    v = _number(value)
    below = [(v >= e if from_edge else v > e).cast("int") for e in sorted(map(float, edges))]
    return F.when(v.isNotNull(), sum(below, F.lit(0)))


def range_of(value: Column, edges: Sequence[float]) -> Column:
    """Struct (above, upto) of the two edges that a value lies between, the upper one included; null outside all."""
    v, e, out = _number(value), sorted(map(float, edges)), None
    for low, high in zip(e, e[1:], strict=False):
        inside, pair = (v > low) & (v <= high), F.struct(F.lit(low).alias("above"), F.lit(high).alias("upto"))
        out = F.when(inside, pair) if out is None else out.when(inside, pair)
    return F.lit(None).cast("struct<above:double,upto:double>") if out is None else out


def range_label(value: Column, edges: Sequence[float], unit: str = "km") -> Column:
    r = range_of(value, edges)
    return F.when(r.isNotNull(), F.format_string(f"%d-%d {unit}", r["above"].cast("long"), r["upto"].cast("long")))


def sky_class(light: Column, very_dark: float = VERY_DARK, dark: float = DARK) -> Column:
    """very dark, dark or lit; null without a measure."""
    n = band(light, (very_dark, dark))
    return F.when(n == 0, "very dark").when(n == 1, "dark").when(n == 2, "lit")


def town_band(km2: Column, edges: Sequence[float] = TOWN_KM2) -> Column:
    """0 outside towns and in small ones, then one more from each edge on."""
    return F.coalesce(band(km2, edges), F.lit(0))
