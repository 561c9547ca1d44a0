"""Altitudes and weekdays from free text, as column expressions: texts are cut into tokens, and tokens are folded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WEEKDAYS, folded

#: The highest altitude believed, in metres.
HIGHEST_M = 6800.0
#: What may stand between the two ends of a range.
BETWEEN = ("-", "–", "—", "a", "al", "hasta", "y")


def number(token: Column) -> Column:
    """The value of digits with separators. Groups of three digits behind blanks or commas are thousands, a point may
    follow them; behind one point they are if at most two digits precede it; any other single separator is a decimal
    one; null for all else."""
    marks = F.regexp_replace(token, "[0-9]", "")
    groups = F.split(token, "[ ,.]")
    tail = F.element_at(groups, -1)
    threes = lambda parts: F.forall(parts, lambda g: F.length(g) == 3)
    inner, last = F.slice(groups, 2, F.size(groups)), F.slice(groups, 2, F.greatest(F.size(groups) - 2, F.lit(0)))
    short = F.length(groups[0]) <= 3
    text = (
        F.when(marks == "", token)
        .when(~F.contains(marks, F.lit(".")) & short & threes(inner), F.array_join(groups, ""))
        .when((F.instr(marks, ".") == F.length(marks)) & (F.length(marks) > 1) & short & threes(last), F.concat(F.array_join(F.slice(groups, 1, F.size(groups) - 1), ""), F.lit("."), tail))
        .when((marks == ".") & (F.length(groups[0]) <= 2) & threes(inner), F.array_join(groups, ""))
        .when(marks.isin(".", ","), F.array_join(groups, "."))
    )
    return text.cast("double")


def altitude(c: Column) -> Column:
    """Struct (low, high) in metres from one number or a range of two, thousands by point, comma or blank; nulls if there
    are more numbers, no range between two, or one is out of 0..6,800."""
    text = F.regexp_replace(folded(F.coalesce(c, F.lit(""))), r"(?<=\d)([.,]) +(?=\d{3}(?!\d))", "$1")
    token = r"\d+(?:[ ,.]\d+)*"
    values = F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(0)), number)
    joined = F.trim(F.get(F.split(text, token), F.lit(1)))
    shape = (F.size(values) == 1) | ((F.size(values) == 2) & joined.isin(*BETWEEN))
    good = shape & F.forall(values, lambda v: F.coalesce(v.between(0, HIGHEST_M), F.lit(False)))
    return F.struct(F.when(good, F.array_min(values)).alias("low"), F.when(good, F.array_max(values)).alias("high"))


#: What a word of an opening text is, besides a weekday's number.
_TO, _BUT, _SHUT, _PASS, _OTHER = 10, 11, 12, 13, 14


def _kind(word: Column) -> Column:
    days = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.when(word.isin("sabados", "domingos"), F.substring(word, 1, F.length(word) - 1)).otherwise(word))
    return (
        F.when(days > 0, days.cast("int") - 1)
        .when(word.isin("a", "al", "hasta", "-", "–"), _TO)
        .when(word.isin("excepto", "salvo", "menos"), _BUT)
        .when(word.rlike("^cerrad[oa]s?$"), _SHUT)
        .when(word.isin("los", "el", "dia", "dias"), _PASS)
        .otherwise(_OTHER)
    )


def _span(first: Column, last: Column) -> Column:
    """Bits of the weekdays from first to last, over Sunday if need be."""
    steps = F.sequence(F.lit(0), F.pmod(last - first, F.lit(7)))
    return F.aggregate(steps, F.lit(0), lambda bits, k: bits.bitwiseOR(_bit(F.pmod(first + k, F.lit(7)))))


def _bit(day: Column) -> Column:
    return F.pow(F.lit(2), day).cast("int")


def open_days(c: Column) -> Column:
    """Sorted weekdays (Monday 0) that a text opens on: ranges that may wrap, lists, every day, and exceptions; null if it
    names none. A weekday before a closing word, or the first one after it, is shut."""
    text = F.regexp_replace(folded(F.coalesce(c, F.lit(""))), r"\bno (?:se )?(?:atiende|abre|hay atencion)\b", "cerrado")
    kinds = F.transform(F.regexp_extract_all(text, F.lit("[a-zñ]+|[-–]"), F.lit(0)), _kind)
    state = lambda on, off, day, want: F.struct(on.alias("on"), off.alias("off"), day.alias("day"), want.alias("want"))
    none, plain = F.lit(-1), F.lit(0)

    def step(s: Column, k: Column) -> Column:
        on, off, day, want = s["on"], s["off"], s["day"], s["want"]
        weekday = F.when(want == _BUT, state(on, off.bitwiseOR(_bit(k)), none, plain)).when((want == _TO) & (day >= 0), state(on.bitwiseOR(_span(day, k)), off, k, plain)).otherwise(state(on.bitwiseOR(_bit(k)), off, k, plain))
        shut = F.when((day >= 0) & (want != _BUT), state(on.bitwiseAND(F.bitwise_not(_bit(day))), off.bitwiseOR(_bit(day)), none, plain)).otherwise(state(on, off, none, F.lit(_BUT)))
        return (
            F.when(k < 7, weekday)
            .when(k == _TO, state(on, off, day, F.when(day >= 0, F.lit(_TO)).otherwise(plain)))
            .when(k == _BUT, state(on, off, none, F.lit(_BUT)))
            .when(k == _SHUT, shut)
            .when(k == _PASS, s)
            .otherwise(state(on, off, none, plain))
        )

    end = F.aggregate(kinds, state(F.lit(0), F.lit(0), F.lit(-1), F.lit(0)), step)
    every = text.rlike(r"todos los dias|diariamente|\bdiario\b|toda la semana") | ((end["on"] == 0) & (end["off"] > 0))
    on = F.when(every, F.lit(127)).otherwise(end["on"])
    days = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda d: (on.bitwiseAND(_bit(d)) > 0) & (end["off"].bitwiseAND(_bit(d)) == 0))
    return F.when(on > 0, days)
