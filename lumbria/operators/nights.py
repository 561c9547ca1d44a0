"""What each night of a trip is for: rest, a show, the stars, or going out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes from the base that a show may be away, and the least share of clear nights for the stars.
SHOW_MOST_MIN, CLEAR_LEAST = 60, 0.4


def nearest_shows(shows: DataFrame, most: int = SHOW_MOST_MIN) -> DataFrame:
    """(zone, show): of each zone's shows (zone, id, minutes, days) within reach of the base the nearest, then the least id;
    days are its weekdays, Monday 0, null for all."""
    near = shows.where(F.col("minutes") <= most)
    return near.groupBy("zone").agg(F.min(F.struct("minutes", "id", "days")).alias("show"))


def night_kinds(arrives: Column, leaves: Column, start: Column, out: Column, venues: Column, high: Column, stars: Column, clear: Column, show: Column, dark: Column) -> Column:
    """Array of struct (night, kind), by night, of a trip that sleeps at its base from night `arrives` to `leaves` - 1.

    rest: the first night of who wants to go out, where there are venues, at a height that the body isn't used to. show:
    the first free night on which it plays; where that is always or the date is open, not the first night if there is
    another. stars: of the free nights, of all if none is free, with a date (start: the first day's) the one with most
    hours without moon (dark: map of night to hours), the earlier of equals; else the second night if it is free, or the
    first free one; not where under CLEAR_LEAST of nights are known to be clear. out: all that are left, where there are
    venues. A trip without nights has none; unknown wishes count as no.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    none = F.array().cast("array<int>")
    nights = F.when(leaves > arrives, F.sequence(arrives, leaves - 1)).otherwise(none)
    first = F.get(nights, F.lit(0))
    goes = yes(out) & yes(venues)
    rest = F.when(goes & yes(high), first)
    but = lambda c, *used: F.filter(c, lambda n: F.forall(F.array(*used), lambda u: yes(u != n) | u.isNull()))
    free = but(nights, rest)
    # Monday is 0 in days; the first night is that of the day the trip starts.
    plays = F.filter(free, lambda n: F.array_contains(show["days"], F.weekday(F.date_add(start, n - 1))))
    later = F.when((F.size(free) > 1) & (F.get(free, F.lit(0)) == first), F.get(free, F.lit(1))).otherwise(F.get(free, F.lit(0)))
    at_show = F.when(show.isNotNull(), F.when(start.isNotNull() & show["days"].isNotNull(), F.get(plays, F.lit(0))).otherwise(later))
    left = but(nights, rest, at_show)
    left = F.when(F.size(left) > 0, left).otherwise(nights)
    darkest = F.array_max(F.transform(left, lambda n: F.struct(F.coalesce(dark[n], F.lit(-1.0)).alias("hours"), (-n).alias("n"))))
    second = F.get(nights, F.lit(1))
    dated = -darkest["n"]
    open_ = F.when(yes(F.array_contains(left, second)), second).otherwise(F.get(left, F.lit(0)))
    sky = yes(stars) & yes(clear.isNull() | (clear >= CLEAR_LEAST)) & (F.size(nights) > 0)
    at_stars = F.when(sky, F.when(start.isNotNull(), dated).otherwise(open_))
    kind = lambda n: F.when(yes(n == at_stars), "stars").when(yes(n == at_show), "show").when(yes(n == rest), "rest").when(goes, "out")
    return F.filter(F.transform(nights, lambda n: F.struct(n.alias("night"), kind(n).alias("kind"))), lambda x: x["kind"].isNotNull())


def night_plans(trips: DataFrame, zones: DataFrame, shows: DataFrame, dark: DataFrame) -> DataFrame:
    """(trip, night, kind, show) for each night of trips (trip, zone, arrives, leaves, start, out, stars, high) that has a
    kind; show: the id of what plays. zones: (zone, venues, clear); dark: (zone, day, hours) without moon.

    Zones and shows are one row a zone; dark hours are asked for by zone and night of dated trips alone."""
    n = trips.where("start IS NOT NULL AND stars AND leaves > arrives").select("trip", "zone", F.explode(F.sequence("arrives", F.col("leaves") - 1)).alias("night"), "start")
    n = n.withColumn("day", F.date_add("start", F.col("night") - 1)).join(dark.select("zone", "day", "hours"), ["zone", "day"])
    hours = n.groupBy("trip").agg(F.map_from_entries(F.collect_list(F.struct("night", "hours"))).alias("dark"))
    t = trips.join(zones.select("zone", "venues", "clear"), "zone", "left").join(nearest_shows(shows), "zone", "left").join(hours, "trip", "left")
    kinds = night_kinds(*(F.col(c) for c in ("arrives", "leaves", "start", "out", "venues", "high", "stars", "clear", "show", "dark")))
    rows = t.select("trip", "show", F.explode(kinds).alias("n"))
    return rows.select("trip", "n.night", "n.kind", F.when(F.col("n.kind") == "show", F.col("show.id")).alias("show"))
