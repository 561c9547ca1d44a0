"""Day plans, exact optima, visiting orders and cost bands: one bounded group of candidates a trip."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPEAT, PER_DAY, LUNCH = 0.8, 6, 60
#: Seeded or not, and the power of a stop's value in the ranking of insertions.
STARTS = ((False, 1.0), (True, 1.0), (False, 0.5))


def minutes_between(lat: np.ndarray, lon: np.ndarray, km_per_hour: float = 40.0) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a)[:, None] * np.cos(a) * np.sin((b[:, None] - b) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1, h))) * 60 / km_per_hour


class Day:
    """A day that begins and ends at place 0; stops have opening times and lunch falls in between.

    A moment of a day is (time, place, whether lunch was had). after() leads from one to the next, so a route keeps its
    moments and a change is followed from where it begins.
    """

    def __init__(self, start: int, limit: int, travel: np.ndarray, visit: np.ndarray, opens: np.ndarray, closes: np.ndarray):
        self.start, self.limit, self.travel, self.visit, self.opens, self.closes = start, limit, travel, visit, opens, closes

    def first(self) -> tuple[float, int, bool]:
        return float(self.start), 0, False

    def after(self, moment: tuple[float, int, bool], s: int) -> tuple[float, int, bool] | None:
        """When stop s has been visited; None if it is shut by then or opens over an hour after the arrival."""
        t, at, ate = moment
        t += self.travel[at, s]
        if not ate and t >= 13 * 60:
            t, ate = t + LUNCH, True
        ready = max(t, self.opens[s])
        done = ready + self.visit[s]
        return None if ready - t > 60 or done > self.closes[s] else (done, s, ate)

    def moments(self, stops: Iterable[int], begin: tuple[float, int, bool] | None = None) -> list[tuple[float, int, bool]] | None:
        out = [begin or self.first()]
        for s in stops:
            nxt = self.after(out[-1], s)
            if nxt is None:
                return None
            out.append(nxt)
        return out

    def used(self, moment: tuple[float, int, bool]) -> float | None:
        """Minutes from start to the return from here; None if the day is over by then."""
        t, at, ate = moment
        n = t + self.travel[at, 0] - self.start
        return n if n <= self.limit + LUNCH * ate else None

    def arrivals(self, route: list[int]) -> tuple[list[float], float] | None:
        """Arrival at each stop, waiting included, and minutes from start to the return; None if the route can't be made."""
        m = self.moments(route)
        n = m and self.used(m[-1])
        return None if n is None else ([t - self.visit[s] for t, s, _ in m[1:]], n)


def _insertions(route: list[int], day: Day, free: np.ndarray, gain: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(gain a minute, position, stop) of all insertions into a route, the best first: one table of detours, sorted."""
    a, b = np.array([0, *route]), np.array([*route, 0])
    detour = day.travel[a][:, free] + day.travel[free][:, b].T - (day.travel[a, b][:, None] if route else 0.0) + day.visit[free]
    rate = gain[free] / np.maximum(detour, 1.0)
    for k in np.lexsort((np.tile(free, len(a)), np.repeat(np.arange(len(a)), len(free)), -rate.ravel())):
        pos, i = divmod(int(k), len(free))
        yield float(rate[pos, i]), pos, int(free[i])


def _filled(routes: list[list[int]], days: list[Day], value: np.ndarray, kinds: np.ndarray, power: float) -> None:
    """Inserts stops as long as one fits, each time the one with most gain a minute anywhere."""
    free = np.setdiff1d(np.arange(1, len(value)), [s for r in routes for s in r])
    while len(free):
        seen = np.bincount(kinds[[s for r in routes for s in r]], minlength=int(kinds.max()) + 1) if any(routes) else np.zeros(int(kinds.max()) + 1, int)
        gain = (value * REPEAT ** seen[kinds]) ** power
        best = None
        for k, (r, d) in enumerate(zip(routes, days, strict=True)):
            if len(r) >= PER_DAY:
                continue
            moments = d.moments(r)
            for rate, pos, s in _insertions(r, d, free, gain):
                if best and rate <= best[0]:
                    break
                m = d.moments([s, *r[pos:]], moments[pos])
                if m and d.used(m[-1]) is not None:
                    best = (rate, k, pos, s)
                    break
        if best is None:
            return
        routes[best[1]].insert(best[2], best[3])
        free = free[free != best[3]]


def shortened(route: list[int], day: Day) -> list[int]:
    """Turns round the stretch whose turning saves most, until none does."""
    while True:
        moments = day.moments(route)
        best, saved = None, 1e-9
        now = day.used(moments[-1]) if moments else None
        if now is None:
            return route
        for i in range(len(route) - 1):
            for j in range(i + 2, len(route) + 1):
                turned = [*route[i:j][::-1], *route[j:]]
                m = day.moments(turned, moments[i])
                n = m and day.used(m[-1])
                if n is not None and now - n > saved:
                    best, saved = [*route[:i], *turned], now - n
        if best is None:
            return route
        route = best


def plan(days: list[Day], value: np.ndarray, kind: list[str]) -> list[list[int]]:
    """Routes of stops 1.. by day: of a few beginnings, each filled, shortened and filled again, that with most value."""
    kinds = np.unique(kind, return_inverse=True)[1]
    results = []
    for seeded, power in STARTS:
        routes: list[list[int]] = [[] for _ in days]
        if seeded:  # each day begins with the most valuable stop that it can hold, the nearest of equals
            for r, d in zip(routes, days, strict=True):
                taken = {s for x in routes for s in x}
                alone = (s for s in np.lexsort((np.arange(1, len(value)), d.travel[0, 1:], -value[1:])) + 1 if int(s) not in taken and d.arrivals([int(s)]))
                r.extend(int(s) for s in islice(alone, 1))
        for _ in range(2):
            _filled(routes, days, value, kinds, power)
            routes = [shortened(r, d) for r, d in zip(routes, days, strict=True)]
        results.append((worth(routes, value, kind), routes))
    top = max(w for w, _ in results)
    return next(r for w, r in results if w >= top - 1e-9)


def worth(routes: list[list[int]], value: np.ndarray, kind: list[str]) -> float:
    """Value of all stops, the k-th of a kind counting REPEAT ** k."""
    order = [s for r in routes for s in r]
    nth = [sum(kind[x] == kind[s] for x in order[:n]) for n, s in enumerate(order)]
    return float(sum(value[s] * REPEAT**k for s, k in zip(order, nth, strict=True)))


def _arrays(g: pd.DataFrame, start: int, limit: int):
    g = g.sort_values("stop")
    lat, lon = np.r_[g["base_lat"].iloc[0], g["lat"]], np.r_[g["base_lon"].iloc[0], g["lon"]]
    pad = lambda c, v: np.r_[v, g[c].to_numpy(float)]
    d = Day(start, limit, minutes_between(lat, lon), pad("visit", 0), pad("opens", 0), pad("closes", 1440))
    return g["stop"].tolist(), d, pad("value", 0), ["", *g["kind"]]


def day_plans(stops: DataFrame, trip: str = "trip", start: int = 8 * 60, limit: int = 10 * 60) -> DataFrame:
    """Stops (trip, stop, lat, lon, base_lat, base_lon, visit, opens, closes, value, kind, days) to rows (trip, day, place,
    stop, arrives). A trip's candidates are few (a zone's best 40), so a trip is a group, and trips run side by side."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        names, d, value, kind = _arrays(g, start, limit)
        rows = []
        for k, r in enumerate(plan([d] * int(g["days"].iloc[0]), value, kind)):
            rows += [(g[trip].iloc[0], k + 1, p + 1, names[s - 1], round(t, 3)) for p, (s, t) in enumerate(zip(r, d.arrivals(r)[0], strict=True))]
        return pd.DataFrame(rows, columns=[trip, "day", "place", "stop", "arrives"])

    return stops.groupBy(trip).applyInPandas(one, f"{trip} long, day int, place int, stop long, arrives double")


#: Stops above which an exact day is not searched.
EXACT_STOPS = 18


def exact_day(stops: DataFrame, trip: str = "trip", limit: int = 10 * 60) -> DataFrame:
    """(trip, best): most value of any round trip within limit, without opening hours, by dynamic programming over the
    subsets, a layer of equal size at once; null for trips of more than EXACT_STOPS stops. optimum.exact_plans() has
    hours, lunch and several days."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        _, d, value, _ = _arrays(g, 0, limit)
        n = len(value) - 1
        if n > EXACT_STOPS:
            return pd.DataFrame({trip: [g[trip].iloc[0]], "best": [np.nan]})
        cost = np.full((1 << n, n), np.inf)
        cost[1 << np.arange(n), np.arange(n)] = d.travel[0, 1:] + d.visit[1:]
        masks = np.arange(1 << n)
        size = np.bitwise_count(masks)
        for layer in range(1, n):
            own = masks[size == layer]
            for s in range(n):
                m = own[own >> s & 1 == 0]
                cost[m | 1 << s, s] = (cost[m] + d.travel[1:, s + 1]).min(1) + d.visit[s + 1]
        done = (cost + d.travel[1:, 0]).min(1) <= limit
        sums = (masks[:, None] >> np.arange(n) & 1) @ value[1:]
        return pd.DataFrame({trip: [g[trip].iloc[0]], "best": [float(sums[done].max()) if done.any() else 0.0]})

    out = stops.groupBy(trip).applyInPandas(one, f"{trip} long, best double")
    return out.withColumn("best", F.nanvl("best", F.lit(None).cast("double")))


def visiting_orders(stops: DataFrame, trip: str = "trip") -> DataFrame:
    """(trip, by_value, by_nearest, two_opt): minutes of the round trip in three orders of all stops."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        _, d, value, _ = _arrays(g, 0, 10**9)
        tour = lambda o: float(sum(d.travel[a, b] for a, b in zip([0, *o], [*o, 0], strict=True)))
        ranked = sorted(range(1, len(value)), key=lambda s: (-value[s], s))
        left, near, at = set(ranked), [], 0
        while left:
            at = min(left, key=lambda s: (d.travel[at, s], s))
            near.append(at)
            left.discard(at)
        best = list(near)
        while True:
            tries = [[*best[:i], *reversed(best[i:j]), *best[j:]] for i in range(len(best)) for j in range(i + 2, len(best) + 1)]
            nxt = min(tries, key=tour, default=best)
            if tour(nxt) >= tour(best) - 1e-9:
                break
            best = nxt
        return pd.DataFrame({trip: [g[trip].iloc[0]], "by_value": [tour(ranked)], "by_nearest": [tour(near)], "two_opt": [tour(best)]})

    return stops.groupBy(trip).applyInPandas(one, f"{trip} long, by_value double, by_nearest double, two_opt double")


def cost_bands(trips: DataFrame, ranges: dict[str, tuple[float, float]], amounts: dict[str, str], runs: int = 2000, seed: int = 20240917) -> DataFrame:
    """trips with p20, p50, p80 of the total cost. Each parameter is drawn evenly from its range by a sequence seeded with
    its own name, so that a trip has the same band wherever it runs; amounts: parameter -> the column it is taken times."""
    draws = {n: np.random.default_rng([seed, zlib.crc32(n.encode())]).uniform(lo, hi, runs) for n, (lo, hi) in ranges.items()}
    names = list(amounts)
    base = np.stack([draws[n] for n in names])

    @F.pandas_udf("p20 double, p50 double, p80 double")
    def bands(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in it:
            k = np.stack([c.to_numpy(float) for c in (cols if isinstance(cols, tuple) else (cols,))], axis=1)
            out = [np.percentile(k[i : i + 256] @ base, [20, 50, 80], axis=1).T for i in range(0, len(k), 256)]
            yield pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 3)), columns=["p20", "p50", "p80"])

    # Trips with the same amounts have the same band: each combination is drawn once.
    columns = list(dict.fromkeys(amounts[n] for n in names))
    once = trips.select(*(F.col(c).alias(f"_{c}") for c in columns)).distinct()
    once = once.withColumn("_b", bands(*(F.col(f"_{amounts[n]}") for n in names)))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))
    return trips.join(once, same, "left").select(*trips.columns, "_b.*")


def best_order(stops: DataFrame, trip: str = "trip", most: int = 7) -> DataFrame:
    """(trip, given, best): minutes of the round trip in the order of the stops' places, and in the best order of all.

    Over subsets, the shortest way that ends at each stop; an error for trips of more than `most` stops."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > most:
            raise ValueError(f"trip {g[trip].iloc[0]} has {len(g)} stops; {most} at most")
        _, d, _, _ = _arrays(g, 0, 10**9)
        n, t = len(g), d.travel
        tour = sum(t[a, b] for a, b in zip(range(n + 1), [*range(1, n + 1), 0], strict=True))
        ways = {(1 << s, s): t[0, s + 1] for s in range(n)}
        for size in range(2, n + 1):
            ways = {
                (m | 1 << s, s): min(c + t[last + 1, s + 1] for (m2, last), c in ways.items() if m2 == m)
                for m in {m for m, _ in ways} if m.bit_count() == size - 1
                for s in range(n) if not m >> s & 1
            }
        best = min(c + t[s + 1, 0] for (_, s), c in ways.items())
        return pd.DataFrame({trip: [g[trip].iloc[0]], "given": [float(tour)], "best": [float(best)]})

    return stops.groupBy(trip).applyInPandas(one, f"{trip} long, given double, best double")
