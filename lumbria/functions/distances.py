"""Kilometres and minutes out of a cell such as "12 km / 1 h 20 min", as column expressions over its quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import folded

# Number words before a unit, a nautical mile in km, and the fastest way that a text can mean.
WORDS = {
    "un": 1, "una": 1, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "doce": 12, "quince": 15, "veinte": 20, "treinta": 30, "cuarenta": 40, "cuarenta y cinco": 45,
    "cincuenta": 50,
}
MILE_KM, FASTEST_KMH = 1.852, 150.0

#: Units by how their words begin, in the order in which they are tried.
_UNITS = (("mn", r"^milla"), ("km", r"^k"), ("min", r"^(?:m[iu][nm]|')"), ("mt", r"^(?:met|mtr|mts|mt|ms)"), ("m", r"^m"), ("h", r"^h"), ("d", r"^dia"), ("s", r"^seg"))
#: Minutes of a unit of time, and how large it is: a time goes on while units get smaller.
_MINUTES, _RANK = {"d": 1440.0, "h": 60.0, "min": 1.0, "s": 1 / 60}, {"d": 4, "h": 3, "min": 2, "s": 1}
_QUANTITY = r"(?:\d{1,2}:[0-5]\d|\d+(?:[.,]\d+)?)\s*(?:[a-z]+|')?"


def _prepared(text: Column) -> Column:
    t = F.regexp_replace(folded(F.coalesce(text, F.lit(""))), "½", " 1/2")
    for word in sorted(WORDS, key=len, reverse=True):
        t = F.regexp_replace(t, rf"\b{word}\s+(?=(?:hora|hr|minuto|dia|kilometro|km|metro))", f"{WORDS[word]} ")
    t = F.regexp_replace(t, r"\b(?:1 )?cuarto de hora\b|\bun cuarto de hora\b", "15 min")
    t = F.regexp_replace(t, r"\bmedia\s+hora\b", "30 min")
    t = F.regexp_replace(t, r"(\d)\s*(h[a-z]*|dias?)\.?\s*(?:y\s+medi[ao]|1/2)\b", "$1.5 $2")
    t = F.regexp_replace(F.regexp_replace(t, r"(\d) +1/2", "$1.5"), r"(?<![\d.,/])1/2", "0.5")
    t = F.regexp_replace(t, r"(\d)([.,])\s+(?=\d)", "$1$2")
    t = F.regexp_replace(t, r"\bk\.\s?m\.?|\bk\s+m\b", "km")
    return F.regexp_replace(t, r"(\d)[.,](?=\s*[a-z'])", "$1 ")


def _value(number: Column) -> Column:
    return F.regexp_replace(number, ",", ".").cast("double")


def _metres(number: Column) -> Column:
    """Three digits behind a separator are thousands' rest."""
    return F.when(number.rlike(r"^\d{1,3}[.,]\d{3}$"), F.regexp_replace(number, "[.,]", "").cast("double")).otherwise(_value(number))


def _hours(number: Column) -> Column:
    """Struct of the minutes that hours with decimals are, and whether two decimals made it hours and minutes."""
    parts = F.split(F.regexp_replace(number, ",", "."), r"\.")
    two = (F.size(parts) == 2) & F.get(parts, F.lit(1)).rlike(r"^[0-5]\d$") & (F.get(parts, F.lit(1)) != "00")
    return F.struct(F.when(two, parts[0].cast("double") * 60 + F.get(parts, F.lit(1)).cast("double")).otherwise(_value(number) * 60).alias("minutes"), F.coalesce(two, F.lit(False)).alias("doubtful"))


def distance_time(c: Column) -> Column:
    """Struct (km, minutes, ambiguous) of a way's cell.

    Kilometres are the first number with a unit of length; metres right behind them are added. Minutes add up units that
    get smaller and end where one repeats. A lone m is minutes behind hours, behind a distance that has been read, and
    with fewer than three digits right behind kilometres; else metres. h:mm is hours and minutes; with minutes behind it,
    minutes and seconds. Hours with two decimals are read as h.mm and are ambiguous, and so are minutes that would be
    faster than FASTEST_KMH and are taken for hours. Numbers without a unit mean nothing.
    """
    found = F.regexp_extract_all(_prepared(c), F.lit(_QUANTITY), F.lit(0))

    def quantity(q: Column) -> Column:
        word = F.regexp_extract(q, r"([a-z']+)$", 1)
        unit = F.coalesce(*(F.when(word.rlike(p), F.lit(u)) for u, p in _UNITS))
        return F.struct(F.regexp_extract(q, r"^([\d:.,]+)", 1).alias("n"), unit.alias("u"))

    def state(s: Column, **new: Column) -> Column:
        names = ("km", "minutes", "as_hours", "timed", "closed", "rank", "last", "doubt")
        return F.struct(*((new[k] if k in new else s[k]).alias(k) for k in names))

    def step(s: Column, q: Column) -> Column:
        n, clock = q["n"], q["n"].contains(":")
        behind_km = (s["last"] == "km") & ~s["timed"]
        lone = F.when(s["last"] == "h", "min").when(behind_km, F.when(n.rlike(r"^\d{3}$"), "mt").otherwise("min")).when(s["km"].isNotNull(), "min").otherwise("mt")
        u = F.when(q["u"] == "m", lone).otherwise(F.coalesce(q["u"], F.when(clock, "h")))
        length = F.when(u == "km", _value(n)).when(u == "mn", _value(n) * MILE_KM).when(u == "mt", _metres(n) / 1000)
        a, b = F.split(n, ":")[0].cast("double"), F.get(F.split(n, ":"), F.lit(1)).cast("double")
        decimal_hours = _hours(n)
        minutes = F.when(clock, F.when(u == "min", a + b / 60).otherwise(a * 60 + b)).when(u == "h", decimal_hours["minutes"])
        minutes = F.coalesce(minutes, *(F.when(u == k, _value(n) * v) for k, v in _MINUTES.items()))
        other = F.when(clock & (u == "min"), a * 60 + b).when((u == "min") & n.rlike("[.,]"), decimal_hours["minutes"]).otherwise(minutes)
        rank = F.coalesce(*(F.when(u == k, F.lit(v)) for k, v in _RANK.items()))
        goes_on = ~s["closed"] & (rank < s["rank"])
        add = (u == "mt") & behind_km
        with_length = state(s, km=F.when(add, s["km"] + length).otherwise(F.coalesce(s["km"], length)), last=u, closed=s["closed"] | (s["timed"] & ~add))
        with_time = state(s, minutes=s["minutes"] + minutes, as_hours=s["as_hours"] + other, timed=F.lit(True), rank=F.when(clock & (u == "h"), F.lit(_RANK["min"])).otherwise(rank), last=u, doubt=s["doubt"] | ((u == "h") & ~clock & decimal_hours["doubtful"]))
        return F.when(length.isNotNull() & ~clock, with_length).when(rank.isNotNull() & goes_on, with_time).when(rank.isNotNull(), state(s, closed=F.lit(True))).otherwise(s)

    start = F.struct(F.lit(None).cast("double").alias("km"), F.lit(0.0).alias("minutes"), F.lit(0.0).alias("as_hours"), F.lit(False).alias("timed"), F.lit(False).alias("closed"), F.lit(99).alias("rank"), F.lit("").alias("last"), F.lit(False).alias("doubt"))
    end = F.aggregate(F.filter(F.transform(found, quantity), lambda q: q["u"].isNotNull() | q["n"].contains(":")), start, step)
    too_fast = end["timed"] & (end["minutes"] > 0) & (end["as_hours"] != end["minutes"]) & (end["km"] / (end["minutes"] / 60) > FASTEST_KMH)
    fast = F.coalesce(too_fast, F.lit(False))
    return F.struct(end["km"].alias("km"), F.when(end["timed"], F.round(F.when(fast, end["as_hours"]).otherwise(end["minutes"]), 2)).alias("minutes"), (end["timed"] & (end["doubt"] | fast)).alias("ambiguous"))
