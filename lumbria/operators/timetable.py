"""Timetables of given routes: one fold over a route's stops in column expressions, so a route is a row and nothing else."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

DAY, NEVER = 24 * 60, 10**6


@dataclass(frozen=True)
class Habits:
    """Minutes of a day. Lunch takes `lunch`; it is had from `noon` on, from `early` on where it would otherwise be after
    `late`. Nobody waits at a door for over `wait`, and no way to or from a minor stop is longer than `short`."""

    lunch: int = 60
    early: int = 11 * 60 + 30
    noon: int = 12 * 60 + 30
    late: int = 14 * 60
    wait: int = 60
    short: int = 90


LUNCH = "struct<after:int,at:bigint,stop:bigint,inside:boolean>"
VISITS = "array<struct<stop:bigint,arrives:bigint,leg:bigint,waits:bigint>>"


def pace_at(minute: Column, pace: Sequence[tuple[float, float]]) -> Column:
    """Factor of a way that begins at this minute: straight lines between measured minutes, round midnight as well."""
    if not pace:
        return F.lit(1.0)
    p = sorted((float(m), float(f)) for m, f in pace)
    p = [(p[-1][0] - DAY, p[-1][1]), *p, (p[0][0] + DAY, p[0][1])]
    m, out = F.pmod(minute.cast("double"), F.lit(float(DAY))), F.lit(None).cast("double")
    for (m1, f1), (m2, f2) in zip(p, p[1:], strict=False):
        out = F.when((m >= m1) & (m <= m2), f1 + (m - m1) * ((f2 - f1) / (m2 - m1) if m2 > m1 else 0.0)).otherwise(out)
    return out


def whole(x: Column) -> Column:
    return F.rint(x).cast("long")


def timetables(routes: DataFrame, habits: Habits = Habits(), pace: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """routes with `plan`: null if the route can't be made, else a struct of leaves, returns, minutes (lunch within the day
    not counted), lunch (visits before it, time, stop or null at the base, whether within the day) and visits (stop,
    arrives, leg, waits).

    routes: start, cap (minutes), weekday (null: any), food (whether the base has any), back (minutes of the last way) and
    stops, an array of structs of stop, leg (minutes to it from the one before; null: no way), visit, opens, closes, minor,
    weekdays (open ones; null: all) and food. Other columns pass through. A first stop that is still shut is left for
    later instead of waiting at its door. Lunch is had before leaving, at a stop on arrival or after the visit, or at the
    base on return; a stop where one eats on arrival counts from after the meal. No stops, or null: a day of no minutes.
    """
    h = habits
    base = {"opens": F.lit(0), "visit": F.lit(0), "closes": F.lit(NEVER), "food": F.coalesce(F.col("food"), F.lit(False)), "leg": F.col("back")}
    last = F.size("stops") - 1

    def with_next(x: Column, i: Column) -> Column:
        nxt = F.get("stops", i + 1)
        ahead = F.struct(*(F.when(i < last, nxt[k].cast("double") if k == "leg" else nxt[k].cast(t)).otherwise(v.cast("double" if k == "leg" else t)).alias(k) for k, v, t in ((k, v, "boolean" if k == "food" else "long") for k, v in base.items())), (i == last).alias("base"))
        before = (i > 0) & F.coalesce(F.get("stops", i - 1)["minor"], F.lit(False))
        return F.struct(
            i.alias("i"), x["stop"].cast("long").alias("stop"), x["leg"].cast("double").alias("leg"), x["visit"].cast("long").alias("visit"), x["opens"].cast("long").alias("opens"), x["closes"].cast("long").alias("closes"),
            F.coalesce(x["minor"], F.lit(False)).alias("minor"), before.alias("minor_before"), x["weekdays"].alias("weekdays"), F.coalesce(x["food"], F.lit(False)).alias("food"), ahead.alias("next"),
        )

    rows = routes.withColumn("_stops", F.when(F.size("stops") > 0, F.transform("stops", with_next)))
    first = F.get("_stops", F.lit(0))
    rows = rows.withColumn("_leaves", F.greatest(F.col("start").cast("long"), first["opens"] - whole(first["leg"])))
    leaves = F.col("_leaves")
    eats = (leaves >= h.noon) | ((leaves >= h.early) & (leaves + first["leg"] * pace_at(leaves, pace) > h.late))
    meal = F.greatest(F.col("start").cast("long"), F.when(leaves >= h.noon, h.noon).otherwise(h.early))
    meal = F.when(meal + h.lunch <= leaves, meal).otherwise(leaves)
    rows = rows.withColumn("_lunch", F.when(eats, F.struct(F.lit(0).alias("after"), meal.alias("at"), F.lit(None).cast("long").alias("stop"), F.lit(False).alias("inside"))).cast(LUNCH))
    rows = rows.withColumn("_leaves", leaves + F.when(F.col("_lunch.at") == leaves, h.lunch).otherwise(0))
    begin = F.struct(F.lit(True).alias("ok"), F.col("_leaves").alias("now"), F.col("_lunch").alias("lunch"), F.lit(False).alias("promised"), F.array().cast(VISITS).alias("visits"))
    rows = rows.withColumn("_end", F.aggregate("_stops", begin, lambda state, s: F.when(state["ok"], _visit(state, s, h, pace)).otherwise(state)))
    end, way = F.col("_end"), F.col("back").cast("double") * pace_at(F.col("_end.now"), pace)
    returns = end["now"] + whole(way)
    lunch = F.when(end["lunch"].isNull() & (returns >= h.noon), F.struct(F.size("stops").alias("after"), returns.alias("at"), F.lit(None).cast("long").alias("stop"), F.lit(False).alias("inside")).cast(LUNCH)).otherwise(end["lunch"])
    minutes = returns - F.col("_leaves") - F.when(F.coalesce(lunch["inside"], F.lit(False)), h.lunch).otherwise(0)
    near = (way <= h.short) | ~F.coalesce(F.element_at("stops", -1)["minor"], F.lit(False))
    made = end["ok"] & near & (minutes <= F.col("cap")) & (returns <= F.col("start") + F.col("cap") + h.lunch)
    full = F.when(made, F.struct(F.col("_leaves").alias("leaves"), returns.alias("returns"), minutes.alias("minutes"), lunch.alias("lunch"), end["visits"].alias("visits")))
    start = F.col("start").cast("long")
    none = F.struct(start.alias("leaves"), start.alias("returns"), F.lit(0).cast("long").alias("minutes"), F.lit(None).cast(LUNCH).alias("lunch"), F.array().cast(VISITS).alias("visits"))
    return rows.withColumn("plan", F.when(F.size("stops") > 0, full).otherwise(none)).drop("_stops", "_leaves", "_lunch", "_end")


def _visit(state: Column, s: Column, h: Habits, pace: Sequence[tuple[float, float]]) -> Column:
    """The state after a stop."""
    leg = s["leg"] * pace_at(state["now"], pace)
    ends = lambda t, x: F.greatest(t, x["opens"]) + x["visit"]

    def arrived(a: Column) -> Column:
        """a: leg and time t of the arrival."""
        t = a["t"]
        fits = ends(t + h.lunch, s) <= s["closes"]
        in_time = (t >= h.early) & ((s["opens"] - t >= h.lunch) | ((ends(t, s) > h.late) & fits))
        here = state["lunch"].isNull() & (state["promised"] | (t > h.late) | in_time)
        return let(F.struct(here.alias("here"), (t + F.when(here, h.lunch).otherwise(0)).alias("t"), a["leg"].alias("leg"), t.alias("came")), visited)

    def visited(v: Column) -> Column:
        """v: whether one eats on arrival, and when the visit may begin."""
        open_today = s["weekdays"].isNull() | F.col("weekday").isNull() | F.array_contains(s["weekdays"], F.col("weekday"))
        near = (v["leg"] <= h.short) | ~(s["minor"] | s["minor_before"])
        ok = F.coalesce(near & open_today & (s["opens"] - v["t"] <= h.wait) & (ends(v["t"], s) <= s["closes"]), F.lit(False))
        seen = F.struct(s["stop"].alias("stop"), v["t"].alias("arrives"), whole(v["leg"]).alias("leg"), F.greatest(s["opens"] - v["t"], F.lit(0)).alias("waits"))
        lunch = F.when(v["here"], F.struct(s["i"].alias("after"), v["came"].alias("at"), s["stop"].alias("stop"), F.lit(True).alias("inside")).cast(LUNCH)).otherwise(state["lunch"])
        return let(F.struct(ok.alias("ok"), ends(v["t"], s).alias("now"), lunch.alias("lunch"), F.concat(state["visits"], F.array(seen)).cast(VISITS).alias("visits")), leaving)

    def leaving(n: Column) -> Column:
        """n: the moment after the visit. Eats here, or leaves lunch to the next stop or the base."""
        ahead = s["next"]
        t = n["now"] + F.coalesce(whole(ahead["leg"] * pace_at(n["now"], pace)), F.lit(0))

        def decided(t: Column) -> Column:
            fits = ends(t + h.lunch, ahead) <= ahead["closes"]
            too_late = (t > h.late) | ((ends(t, ahead) > h.late) & ~fits)
            hungry = n["lunch"].isNull() & (n["now"] >= h.early)
            now = hungry & (too_late | ((n["now"] >= h.noon) & (s["food"] | ~F.coalesce(ahead["food"], F.lit(False)))))
            there = hungry & (n["now"] >= h.noon) & ~now & fits & ~ahead["base"]
            lunch = F.when(now, F.struct((s["i"] + 1).alias("after"), n["now"].alias("at"), s["stop"].alias("stop"), F.lit(True).alias("inside")).cast(LUNCH)).otherwise(n["lunch"])
            return F.struct(n["ok"].alias("ok"), (n["now"] + F.when(now, h.lunch).otherwise(0)).alias("now"), lunch.alias("lunch"), F.coalesce(there, F.lit(False)).alias("promised"), n["visits"].alias("visits"))

        return let(t, decided)

    return let(F.struct(leg.alias("leg"), (state["now"] + whole(leg)).alias("t")), arrived)
