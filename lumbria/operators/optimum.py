"""Exact plans of a trip: all sets of stops that a day can hold, and the days' sets with most value together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .trips import LUNCH, PER_DAY, REPEAT, Day, _arrays

#: Candidates of a trip that are searched in full, and moments of a day that are followed at once.
MOST_STOPS, MOMENTS = 15, 400_000


def set_values(value: np.ndarray, kind: list[str]) -> np.ndarray:
    """Value of each set of stops, by bit mask: of a kind's stops the k-th most valuable counts REPEAT ** k."""
    n = len(value)
    masks = np.arange(1 << n)
    out = np.zeros(1 << n)
    for k in dict.fromkeys(kind):
        seen = np.zeros(1 << n, np.int64)
        for s in sorted((s for s in range(n) if kind[s] == k), key=lambda s: (-value[s], s)):
            has = masks >> s & 1
            out += has * value[s] * REPEAT**seen
            seen += has
    return out


def day_sets(day: Day, most: int = PER_DAY) -> tuple[dict[int, list[int]], bool]:
    """Each set of stops 1.. that fits into the day in some order, by mask, with such an order; and whether all were found.

    All orders are followed a stop at a time, side by side as arrays. Of orders that reach the same moment with the same
    stops one is followed. Earlier is not always better, as a stop that opens over an hour later is no stop, so moments
    are never dropped for being late. A way back that is too late by now stays so, as detours only take longer."""
    n = len(day.visit) - 1
    back = day.travel[:, 0]
    mask, last, t, ate = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, float(day.start)), np.zeros(1, bool)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    found: dict[int, tuple[int, int]] = {0: (-1, 0)}
    whole = True
    for depth in range(min(most, n)):
        nxt = []
        for s in range(1, n + 1):
            free = np.flatnonzero(mask >> (s - 1) & 1 == 0)
            at = t[free] + day.travel[last[free], s]
            eats = ~ate[free] & (at >= 13 * 60)
            at = at + LUNCH * eats
            ready = np.maximum(at, day.opens[s])
            done, had = ready + day.visit[s], ate[free] | eats
            ok = (ready - at <= 60) & (done <= day.closes[s]) & (done + back[s] - day.start <= day.limit + LUNCH * had)
            free = free[ok]
            nxt.append((mask[free] | 1 << (s - 1), np.full(len(free), s), done[ok], had[ok], free))
        mask, last, t, ate, came = (np.concatenate(c) for c in zip(*nxt, strict=True))
        if not len(mask):
            break
        one = _distinct(mask, last, t, ate)
        if len(one) > MOMENTS:
            one, whole = one[np.argsort(t[one], kind="stable")[:MOMENTS]], False
        mask, last, t, ate, came = mask[one], last[one], t[one], ate[one], came[one]
        steps.append((last, came))
        new, first = np.unique(mask, return_index=True)
        for m, k in zip(new.tolist(), first.tolist(), strict=True):
            found.setdefault(m, (depth, k))
    out = {}
    for m, (depth, k) in found.items():
        route = []
        while depth >= 0:
            stops, came = steps[depth]
            route.append(int(stops[k]))
            k, depth = int(came[k]), depth - 1
        out[m] = route[::-1]
    return out, whole


def _distinct(mask: np.ndarray, last: np.ndarray, t: np.ndarray, ate: np.ndarray) -> np.ndarray:
    """The first place of each moment with its stops."""
    order = np.lexsort((ate, t, last, mask))
    new = np.r_[True, np.any([x[order[1:]] != x[order[:-1]] for x in (mask, last, t, ate)], axis=0)]
    return order[new]


class Search:
    """Which sets so many days can hold, each its own part."""

    def __init__(self, sets: list[int], n: int):
        self.sets = np.array(sorted(sets), np.int64)
        self.fits = np.zeros(1 << n, bool)
        self.fits[self.sets] = True
        self.known: dict[tuple[int, int], int] = {}

    def part(self, mask: int, days: int) -> int:
        """A set for one of the days so that the others can hold the rest; -1 if there is none."""
        if days == 1:
            return mask if self.fits[mask] else -1
        if (mask, days) not in self.known:
            own = self.sets[self.sets & ~mask == 0]
            rest = mask ^ own
            if days == 2:
                good = np.flatnonzero(self.fits[rest])
                self.known[mask, days] = int(own[good[-1]]) if len(good) else -1
            else:
                order = np.argsort(-np.bitwise_count(own.astype(np.uint64)).astype(int), kind="stable")
                self.known[mask, days] = next((int(own[k]) for k in order.tolist() if self.part(int(rest[k]), days - 1) >= 0), -1)
        return self.known[mask, days]


def best_plan(day: Day, days: int, value: np.ndarray, kind: list[str]) -> tuple[float, float, list[list[int]]]:
    """(value, bound, routes) of the most valuable plan of so many such days; stops are 1... Sets are tried from the most
    valuable down, so the first that the days can hold is the best. bound: no plan is worth more; it is the value, unless
    there are more than MOST_STOPS stops, of which the most valuable are searched, or more than MOMENTS moments."""
    all_, top = list(range(1, len(value))), list(range(1, len(value)))
    if len(all_) > MOST_STOPS:
        top = sorted(sorted(all_, key=lambda s: (-value[s], s))[:MOST_STOPS])
    at = np.array([0, *top])
    own = Day(day.start, day.limit, day.travel[np.ix_(at, at)], day.visit[at], day.opens[at], day.closes[at])
    sets, whole = day_sets(own)
    v = set_values(value[top], [kind[s] for s in top])
    few = np.flatnonzero(np.bitwise_count(np.arange(1 << len(top), dtype=np.uint64)) <= PER_DAY * days)
    search = Search([*sets], len(top))
    reach = np.bitwise_or.reduce(search.sets)
    few = few[few & ~reach == 0]
    best = next(int(m) for m in few[np.lexsort((few, -v[few]))] if search.part(int(m), days) >= 0)
    routes, left = [], best
    for k in range(days, 0, -1):
        m = search.part(left, k)
        routes.append([top[s - 1] for s in sets[m]])
        left ^= m
    bound = float(v[best])
    if not whole or len(top) < len(all_):
        # Each kind's most valuable stops, as many as all days hold: T7's bound without the way between them.
        ranked = sorted((value[s] * REPEAT**k for name in dict.fromkeys(kind[1:]) for k, s in enumerate(sorted((s for s in all_ if kind[s] == name), key=lambda s: -value[s]))), reverse=True)
        bound = max(bound, float(sum(ranked[: PER_DAY * days])))
    return float(v[best]), bound, routes


def exact_plans(stops: DataFrame, trip: str = "trip", start: int = 8 * 60, limit: int = 10 * 60) -> DataFrame:
    """Stops as for day_plans() to rows (trip, best, bound, routes): the most value that the trip's days can hold with
    opening hours, lunch and waits, what no plan exceeds, and the stops of each day in order.

    A trip is a group of a zone's best candidates. best equals bound for up to MOST_STOPS of them; larger trips state a
    gap and never fail. Days without stops are empty routes."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        names, d, value, kind = _arrays(g, start, limit)
        best, bound, routes = best_plan(d, int(g["days"].iloc[0]), value, kind)
        return pd.DataFrame({trip: [g[trip].iloc[0]], "best": [best], "bound": [bound], "routes": [[[names[s - 1] for s in r] for r in routes]]})

    return stops.groupBy(trip).applyInPandas(one, f"{trip} long, best double, bound double, routes array<array<long>>")
