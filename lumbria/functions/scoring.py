"""Scores, verdicts and rules of trips as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
VALUE_BY_RANK = {1: 1.0, 2: 2.0, 3: 6.0, 4: 24.0}
VALUE_UNRANKED, OFF_INTEREST = 2.0, 0.25
SEASON_FACTOR = {"viable": 1.0, "advertencia": 0.75, "desaconsejado": 0.4}
WET_MM, FLOOR_MM, WET_MONTHS = 150.0, 50.0, 3
NOVELTY_WEIGHT, NOVELTY_WEIGHT_SURPRISE = 0.3, 0.5
HIGH_M, CLIMB_M, FIRST_DAY_M = 2500, 1000, 500
FAR_MIN, SAVED_MIN, ROAD_SHARE = 16 * 60, 4 * 60, 0.4


def stop_value(rank: Column, other_rank: Column, interests: Column, wanted: Column) -> Column:
    """By the higher of two ranks; a quarter if interests are wanted and none is served."""
    best = F.greatest(rank, other_rank)
    v = F.lit(VALUE_UNRANKED)
    for r, x in VALUE_BY_RANK.items():
        v = F.when(best == r, F.lit(x)).otherwise(v)
    return v * F.when((F.size(wanted) > 0) & ~F.arrays_overlap(interests, wanted), OFF_INTEREST).otherwise(1.0)


def season_verdict(rain_mm: Column, place: Column) -> Column:
    """Two axes: wet in itself, and among the zone's wettest months with some rain at all."""
    absolute, relative = rain_mm >= WET_MM, (place <= WET_MONTHS) & (rain_mm >= FLOOR_MM)
    return F.when(absolute & relative, "desaconsejado").when(absolute | relative, "advertencia").otherwise("viable")


def season_factor(verdict: Column) -> Column:
    out = F.lit(1.0)
    for k, v in SEASON_FACTOR.items():
        out = F.when(verdict == k, F.lit(v)).otherwise(out)
    return out


def route_score(quality: Column, season: Column, night: Column, bus: Column, budget: Column, novelty: Column, surprise: Column) -> Column:
    lam = F.when(surprise, NOVELTY_WEIGHT_SURPRISE).otherwise(NOVELTY_WEIGHT)
    return (1 - lam) * quality * season * night * bus * budget + lam * novelty


def altitude_matters(base_m: Column, origin_m: Column) -> Column:
    """High beds reached from far below; unknown heights don't count."""
    return F.coalesce((base_m >= HIGH_M) & (base_m - origin_m >= CLIMB_M), F.lit(False))


def flies(road_min: Column, air_min: Column, trip_min: Column) -> Column:
    """By air if the road is long, the flight saves enough and doesn't take up a short trip; always if there is no road."""
    return F.when(air_min.isNull(), False).when(road_min.isNull(), True).otherwise((road_min > FAR_MIN) & (road_min - air_min >= SAVED_MIN) & (2 * air_min <= ROAD_SHARE * trip_min))


def novelty(saturation: Column, remoteness: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * (1 - saturation) + 0.5 * remoteness))


def band(value: Column, limits: tuple[float, ...], names: tuple[str, ...], right: bool = True) -> Column:
    """Name of the interval a value is in; limits belong to the left interval if right is true, as in a right-closed cut."""
    out = F.lit(names[-1])
    for limit, name in reversed(list(zip(limits, names, strict=False))):
        out = F.when(value <= limit if right else value < limit, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def circle_interpolated(hour: Column, speeds: list[float]) -> Column:
    """Linear on a circle of 24 hours, speeds at each full hour."""
    a = F.array(*map(F.lit, speeds))
    h = F.pmod(hour, F.lit(24.0))
    i = F.floor(h).cast("int")
    x, y = F.get(a, i), F.get(a, (i + 1) % 24)
    return x + (y - x) * (h - i)


def greedy_bound(items: Column, capacity: Column) -> Column:
    """Total value of items (value, cost), in their order, each taken if it still fits: a fold over the array."""
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("c"))

    def add(acc: Column, x: Column) -> Column:
        fits = acc["c"] + x["cost"] <= capacity
        return F.struct(F.when(fits, acc["v"] + x["value"]).otherwise(acc["v"]).alias("v"), F.when(fits, acc["c"] + x["cost"]).otherwise(acc["c"]).alias("c"))

    return F.aggregate(items, zero, add)["v"]


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The first check that holds, null if none."""
    out = F.lit(None).cast("string")
    for cond, name in reversed(checks):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def all_reasons(*checks: tuple[Column, str], most: int | None = None) -> Column:
    """Names of the checks that hold, in their order."""
    out = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in checks)))
    return F.slice(out, 1, most) if most else out


# Band sets of the published tables, upper limits belonging to the lower band, and forest regions.
RAIN_BANDS = ((30.0, 100.0), ("1_Seguro", "2_Precaucion", "3_Peligro"))
WARMTH_BANDS = ((10.0, 20.0), ("Frio", "Templado", "Calido"))
CLIMATE_BANDS = (
    (500.0, 2300.0, 3500.0, 4000.0, 4800.0),
    ("Cálido / Desértico (Costa)", "Templado Cálido (Yunga)", "Templado Seco (Quechua)", "Frío (Suni)", "Muy Frío (Puna)", "Glacial / Nieve (Janca)"),
)
FOREST, FOREST_REGIONS, FOREST_BELOW_M = "Tropical Húmedo (Selva)", ("LORETO", "UCAYALI", "MADRE DE DIOS", "SAN MARTIN", "AMAZONAS"), 1500.0
COST_BANDS, TICKETED = ((15.0, 60.0), (1, 2, 3)), "MANIFESTACIONES CULTURALES|REALIZACIONES TÉCNICAS"


def climate_zone(altitude: Column, region: Column) -> Column:
    """Natural region by altitude, and the forest's below its altitude; null without one."""
    forest = F.upper(region).isin(*FOREST_REGIONS) & (altitude < FOREST_BELOW_M)
    return F.when(altitude.isNull(), F.lit(None)).when(forest, F.lit(FOREST)).otherwise(band(altitude, *CLIMATE_BANDS))


def cost_index(km: Column, category: Column) -> Column:
    """1 to 3 by distance, a step more where a ticket is usual."""
    return F.least(band(km, *COST_BANDS, right=False).cast("int") + F.when(category.rlike(TICKETED), 1).otherwise(0), F.lit(3))
