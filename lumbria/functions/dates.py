"""Movable feasts and recurring date rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import MONTHS, WEEKDAYS, folded, let

# Weekday names of a rule, Monday first.
DAYS = ("lun", "mar", "mie", "jue", "vie", "sab", "dom")


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by Gauss's method with Lilius and Clavius's corrections."""
    k = F.floor(year / 100)
    shift = F.pmod(F.lit(15) - F.floor((F.lit(13) + 8 * k) / 25) + k - F.floor(k / 4), F.lit(30))
    gap = F.pmod(19 * (year % 19) + shift, F.lit(30))
    late = F.floor(gap / 29) + (F.floor(gap / 28) - F.floor(gap / 29)) * F.floor((year % 19) / 11)
    full = F.lit(21) + gap - late
    sunday = F.lit(7) - F.pmod(year + F.floor(year / 4) + F.pmod(F.lit(2) - k + F.floor(k / 4), F.lit(7)), F.lit(7))
    march = full + F.lit(7) - F.pmod(full - sunday, F.lit(7))
    return F.date_add(F.make_date(year, F.lit(2), F.lit(28)), (march + F.when(_leap(year), F.lit(1)).otherwise(F.lit(0))).cast("int"))


def _leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def clamped(year: Column, month: Column, day: Column) -> Column:
    """The date, or its month's last day."""
    first = F.make_date(year, month, F.lit(1))
    return F.least(F.date_add(first, day - 1), F.last_day(first))


def nth_weekday(year: Column, month: Column, n: Column, weekday: Column) -> Column:
    """n-th given weekday (Monday 0) of the month, n = -1 the last."""
    first = F.make_date(year, month, F.lit(1))
    last = F.last_day(first)
    ahead = F.date_add(first, (F.pmod(weekday - F.weekday(first), F.lit(7)) + 7 * (n - 1)).cast("int"))
    back = F.date_sub(last, (F.pmod(F.weekday(last) - weekday, F.lit(7)) + 7 * (-n - 1)).cast("int"))
    return F.when(n > 0, ahead).otherwise(back)


def rule_dates(rule: Column, year: Column) -> Column:
    """Struct (starts, ends) of the edition of a rule that begins in year; nulls for a text that isn't a rule.

    Rules: fija MM-DD[..MM-DD], pascua N[..N], nesimo MM N DAY [EXTRA], mes MM[..MM]; an end before its start falls in
    the next year.
    """
    part = lambda p, g: F.nullif(F.regexp_extract(rule, p, g), F.lit("")).cast("int")
    fixed, moved, nth, months = r"^fija (\d\d)-(\d\d)(?:\.\.(\d\d)-(\d\d))?$", r"^pascua (-?\d{1,3})(?:\.\.(-?\d{1,3}))?$", rf"^nesimo (\d\d) (-1|[1-5]) ({'|'.join(DAYS)})(?: (\d\d?))?$", r"^mes (\d\d)(?:\.\.(\d\d))?$"
    m1, d1 = part(fixed, 1), part(fixed, 2)
    m2, d2 = F.coalesce(part(fixed, 3), m1), F.coalesce(part(fixed, 4), d1)
    turns = F.when(m2 * 100 + d2 < m1 * 100 + d1, 1).otherwise(0)
    at = easter(year)
    wd = F.array_position(F.array(*map(F.lit, DAYS)), F.regexp_extract(rule, nth, 3)).cast("int") - 1
    nth_at = nth_weekday(year, part(nth, 1), part(nth, 2), wd)
    a, b = part(months, 1), F.coalesce(part(months, 2), part(months, 1))
    span = lambda x, y: F.struct(x.alias("starts"), y.alias("ends"))
    return (
        F.when(rule.rlike(fixed), span(clamped(year, m1, d1), clamped(year + turns, m2, d2)))
        .when(rule.rlike(moved), span(F.date_add(at, part(moved, 1)), F.date_add(at, F.coalesce(part(moved, 2), part(moved, 1)))))
        .when(rule.rlike(nth), span(nth_at, F.date_add(nth_at, F.coalesce(part(nth, 4), F.lit(0)))))
        .when(rule.rlike(months), span(F.make_date(year, a, F.lit(1)), F.last_day(F.make_date(year + F.when(b < a, 1).otherwise(0), b, F.lit(1)))))
        .otherwise(span(F.lit(None).cast("date"), F.lit(None).cast("date")))
    )


def expand_rules(rules: DataFrame, rule: str, first: Column, last: Column) -> DataFrame:
    """Rows of rules with starts and ends of every edition that meets the closed window first..last, in the years of the
    window and the one before."""
    years = F.sequence(F.year(first) - 1, F.year(last))
    d = rules.withColumn("_y", F.explode(years)).withColumn("_d", rule_dates(F.col(rule), F.col("_y")))
    return d.select(*rules.columns, F.col("_d.starts").alias("starts"), F.col("_d.ends").alias("ends")).where((F.col("starts") <= last) & (F.col("ends") >= first))


def month_window(month: Column, today: Column) -> Column:
    """Struct (starts, ends): the whole of the next such month, this one included."""
    year = F.year(today) + F.when(month < F.month(today), 1).otherwise(0)
    first = F.make_date(year, month, F.lit(1))
    return F.struct(first.alias("starts"), F.last_day(first).alias("ends"))


#: Ordinals of a weekday in a month, as prose says them.
_NTH = {"primer": 1, "primero": 1, "segundo": 2, "tercer": 3, "tercero": 3, "cuarto": 4, "quinto": 5, "ultimo": -1}


_MONTH = "|".join(MONTHS)
_AND_TO, _OF, _DAY = r"\s*(?:al?|y|-|–|hasta)\s*(?:el\s+)?", rf"\s+(?:de\s+|del\s+mes\s+de\s+)?({_MONTH})\b", r"(\d{1,2})"
#: How prose names dates, the most exact first.
PROSE = {
    "list": rf"\b{_DAY}(?:\s*,\s*\d{{1,2}})+\s*(?:,|y)\s*{_DAY}{_OF}",
    "same_month": rf"\b{_DAY}{_OF}\s+(?:al|hasta\s+el)\s+{_DAY}\s+del\s+mismo\s+mes\b",
    "range_months": rf"\b{_DAY}{_OF}{_AND_TO}{_DAY}{_OF}",
    "range": rf"\b{_DAY}{_AND_TO}{_DAY}{_OF}",
    "weekday": rf"\b({'|'.join(sorted(_NTH, key=len, reverse=True))})\s+({'|'.join(WEEKDAYS)})(?:\s+de)?(?:l\s+mes\s+de)?\s+({_MONTH})\b",
    "day": rf"\b{_DAY}{_OF}",
    "part": rf"\b(primera|segunda|tercera|ultima)\s+(?:semana|quincena)\s+de\s+({_MONTH})\b",
    "months": rf"\b({_MONTH})\s*(?:a|al|hasta|-|–)\s*(?:el\s+mes\s+de\s+)?({_MONTH})\b",
    "month": rf"\b({_MONTH})\b",
}


def plain_prose(text: Column) -> Column:
    """Folded text with one spelling of the first of a month and of September."""
    t = F.regexp_replace(folded(F.coalesce(text, F.lit("")), False), "septiembre", "setiembre")
    return F.regexp_replace(F.regexp_replace(t, r"\b1(?:ro|ero|er|°|º)\b", "1"), r"\bprimero(?=\s+de\s)", "1")


def prose_rule(text: Column) -> Column:
    """Struct (rule, kind) of the date that a text about a feast names, as rule_dates() reads it; nulls without one.

    Of what it says the most exact counts: a list or range of days, over two months or in one, an ordinal weekday, a day,
    a week or part of a month, months from and to, a month. Of equals the first. operators.feasts weighs all that a text
    names by what stands around it.
    """
    return let(plain_prose(text), _rule_of)


def _rule_of(t: Column) -> Column:
    """prose_rule() of plain prose."""
    number = lambda m: F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), m).cast("string"), 2, "0")
    two = lambda d: F.lpad(d, 2, "0")
    got = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    listed, same, across, within, nth, single, part, months, one = PROSE.values()
    ordinal = F.coalesce(*(F.when(got(nth, 1) == k, F.lit(str(v))) for k, v in _NTH.items()))
    weekday = F.element_at(F.array(*map(F.lit, DAYS)), F.array_position(F.array(*map(F.lit, WEEKDAYS)), got(nth, 2)).cast("int"))
    week = F.when(t.rlike(r"quincena"), F.when(got(part, 1) == "primera", "01,15").otherwise("16,31")).otherwise(F.element_at(F.create_map(*(F.lit(x) for x in ("primera", "01,07", "segunda", "08,14", "tercera", "15,21", "ultima", "25,31"))), got(part, 1)))
    begin, end = F.split(week, ",")[0], F.split(week, ",")[1]
    valid = lambda *ds: [d.cast("int").between(1, 31) for d in ds]
    days = F.transform(F.regexp_extract_all(F.regexp_extract(t, listed, 0), F.lit(r"\d{1,2}"), 0), lambda x: x.cast("int"))
    in_order = (F.array_sort(days) == days) & (F.try_element_at(days, F.lit(-1)) <= 31) & (F.get(days, F.lit(0)) >= 1) & (F.try_element_at(days, F.lit(-1)) - F.get(days, F.lit(0)) <= 15)
    rules = (
        ("list", F.when((F.size(days) > 2) & in_order, F.concat(F.lit("fija "), number(got(listed, 3)), F.lit("-"), two(got(listed, 1)), F.lit(".."), number(got(listed, 3)), F.lit("-"), two(got(listed, 2))))),
        ("same_month", F.when(valid(got(same, 1))[0] & valid(got(same, 3))[0], F.concat(F.lit("fija "), number(got(same, 2)), F.lit("-"), two(got(same, 1)), F.lit(".."), number(got(same, 2)), F.lit("-"), two(got(same, 3))))),
        ("range_months", F.when(valid(got(across, 1))[0] & valid(got(across, 3))[0], F.concat(F.lit("fija "), number(got(across, 2)), F.lit("-"), two(got(across, 1)), F.lit(".."), number(got(across, 4)), F.lit("-"), two(got(across, 3))))),
        ("range", F.when(valid(got(within, 1))[0] & valid(got(within, 2))[0], F.concat(F.lit("fija "), number(got(within, 3)), F.lit("-"), two(got(within, 1)), F.lit(".."), number(got(within, 3)), F.lit("-"), two(got(within, 2))))),
        ("weekday", F.concat(F.lit("nesimo "), number(got(nth, 3)), F.lit(" "), ordinal, F.lit(" "), weekday)),
        ("day", F.when(valid(got(single, 1))[0], F.concat(F.lit("fija "), number(got(single, 2)), F.lit("-"), two(got(single, 1))))),
        ("part", F.concat(F.lit("fija "), number(got(part, 2)), F.lit("-"), begin, F.lit(".."), number(got(part, 2)), F.lit("-"), end)),
        ("months", F.concat(F.lit("mes "), number(got(months, 1)), F.lit(".."), number(got(months, 2)))),
        ("month", F.concat(F.lit("mes "), number(got(one, 1)))),
    )
    first = F.coalesce(*(F.when(r.isNotNull(), F.struct(r.alias("rule"), F.lit(k).alias("kind"))) for k, r in rules))
    return F.struct(first["rule"].alias("rule"), first["kind"].alias("kind"))
