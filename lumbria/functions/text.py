"""Text cleaning, parsing and formatting as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as an empty cell, accents and what they fold to, small words of Spanish titles.
EMPTY = ("", "-", "--", "---", "undefined", "null", "none", "s/d", "n/a")
ACCENTED, PLAIN = "áàâäãéèêëíìîïóòôöõúùûüÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜ", "aaaaaeeeeiiiiooooouuuuAAAAAEEEEIIIIOOOOOUUUU"
PREPOSITIONS = ("de", "del", "y", "e", "o", "u", "en", "a", "al", "con", "por", "para", "sin", "sobre")
ARTICLES = ("el", "la", "los", "las")
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "setiembre", "octubre", "noviembre", "diciembre")
WEEKDAYS = ("lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo")
NBSP = " "
#: Spelling rules, in order, that bring Quechua and Spanish spellings together.
SPELLING = (
    ("x", "j"), ("(?<!c)hu(?=[aeio])", "w"), ("gu(?=a)", "w"), ("qu(?=[ei])", "k"), ("q", "k"), ("c(?![eih])", "k"),
    ("c(?=[ei])", "s"), ("z", "s"), ("v", "b"), ("(?<!c)h", ""), ("ll", "l"), ("y", "i"), (r"(.)\1+", "$1"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapsed(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def cleaned(c: Column) -> Column:
    """collapsed(), or null where the cell says that there is nothing."""
    t = collapsed(c)
    return F.when(~F.lower(t).isin(*EMPTY), t)


def folded(c: Column, keep_enye: bool = True) -> Column:
    """Lower case without accents; ñ stays unless keep_enye is false."""
    t = F.translate(F.lower(c), ACCENTED.lower(), PLAIN.lower())
    return t if keep_enye else F.translate(t, "ñç", "nc")


def without_controls(c: Column) -> Column:
    """No invisible characters, white space collapsed."""
    return collapsed(F.regexp_replace(c, r"[\p{C}&&[^\t\n\r]]", ""))


def redacted(c: Column) -> Column:
    """E-mail addresses, card-like and phone-like numbers and eight-digit identity numbers replaced by a mark."""
    t = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    t = F.regexp_replace(t, r"(?<!\d)(?:\+?51[ -]?)?9\d{2}[ -]?\d{3}[ -]?\d{3}(?!\d)", "[phone]")
    t = F.regexp_replace(t, r"(?<!\d)\(?0\d{1,2}\)?[ -]\d{3}[ -]?\d{3,4}(?!\d)", "[phone]")
    return F.regexp_replace(t, r"(?<![\d.])\d{8}(?![\d.])", "[id]")


#: Words before which a person is named in notices, and what a part of such a name looks like.
CUES = ("contacto", "responsable", "encargad[oa]", "administradora?", "comunicarse con", "coordinar con", "llamar a", "informes con", "señora?", "sra?", "srta", "don", "doña", "lic", "ing", "prof", "dra?")
_NAME = r"\p{Lu}[\p{L}'-]+"


def names_redacted(c: Column) -> Column:
    """Capitalised names of up to five parts, joining words among them, right behind a cue such as contacto: or Sra.,
    replaced by a mark. A name without a cue stays, as does a cue in front of an ordinary word."""
    words = "|".join(CUES)
    cue = rf"(?iu:(?<!\p{{L}})(?:{words})\b\.?)"
    before = rf"{cue}\s*[:,-]?\s*(?:(?:el|la|al)\s+)?(?:{cue}\s*)?(?!{cue})"
    return F.regexp_replace(c, rf"({before}){_NAME}(?:\s+(?:(?:de|del|la|las|los|y)\s+){{0,2}}{_NAME}){{0,4}}", "$1[name]")


def opening_hours(c: Column) -> Column:
    """Struct (opens, closes) as HH:MM from a text with exactly two twelve-hour times; midnight closes at 24:00."""
    t = folded(F.coalesce(cleaned(c), F.lit("")))
    whole = F.regexp_extract_all(t, F.lit(r"(\d{1,2}(?::\d{2})?\s*[ap])\.?\s*m\b"), 1)
    parsed = F.transform(
        whole,
        lambda x: F.struct(
            F.regexp_extract(x, r"^(\d{1,2})", 1).cast("int").alias("h"),
            F.coalesce(F.nullif(F.regexp_extract(x, r":(\d{2})", 1), F.lit("")).cast("int"), F.lit(0)).alias("m"),
            x.endswith("p").alias("p"),
        ),
    )
    good = (F.size(parsed) == 2) & F.forall(parsed, lambda x: x["h"].between(1, 12) & x["m"].between(0, 59))
    minute = lambda i: (F.get(parsed, F.lit(i))["h"] % 12 + F.when(F.get(parsed, F.lit(i))["p"], 12).otherwise(0)) * 60 + F.get(parsed, F.lit(i))["m"]
    close = F.when(minute(1) == 0, F.lit(1440)).otherwise(minute(1))
    return F.struct(F.when(good, hhmm(minute(0))).alias("opens"), F.when(good, hhmm(close)).alias("closes"))


def hhmm(minute: Column) -> Column:
    """Minute of the day as HH:MM; 1440 stays 24:00."""
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))


def clock(minute: Column) -> Column:
    """Like hhmm, counting on past midnight from 00:00."""
    return hhmm(F.pmod(minute.cast("int"), F.lit(1440)))


def minutes_of(text: Column, default: int) -> Column:
    ok = text.rlike(r"^\s*\d+:\d+\s*$")
    part = lambda i: F.trim(F.get(F.split(text, ":"), F.lit(i))).cast("int")
    return F.when(ok, part(0) * 60 + part(1)).otherwise(F.lit(default))


def duration(minutes: Column) -> Column:
    """45 min, 2 h, 2 h 40."""
    m = F.bround(minutes).cast("int")
    h, r = F.floor(m / 60).cast("int"), m % 60
    return F.when(m < 60, F.format_string("%d min", m)).when(r == 0, F.format_string("%d h", h)).otherwise(F.format_string("%d h %02d", h, r))


def thousands(n: Column) -> Column:
    return F.regexp_replace(F.bround(n).cast("long").cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", NBSP)


def money(n: Column) -> Column:
    return F.concat(F.lit("S/" + NBSP), thousands(n))


def listed(items: Column, word: str = "y") -> Column:
    """a, b y c."""
    x = F.filter(items, lambda v: v != "")
    n = F.size(x)
    head = F.array_join(F.slice(x, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 1, F.array_join(x, "")).otherwise(F.concat(head, F.lit(f" {word} "), F.element_at(x, -1)))


def date_span(a: Column, b: Column) -> Column:
    """16 de julio; del 24 al 30 de julio; del 28 de diciembre al 6 de enero."""
    name = lambda d: F.get(F.array(*map(F.lit, MONTHS)), F.month(d) - 1)
    one = F.concat(F.dayofmonth(a).cast("string"), F.lit(" de "), name(a))
    same = F.trunc(a, "month") == F.trunc(b, "month")
    two = F.concat(F.lit("del "), F.dayofmonth(a).cast("string"), F.when(same, F.lit("")).otherwise(F.concat(F.lit(" de "), name(a))), F.lit(" al "), F.dayofmonth(b).cast("string"), F.lit(" de "), name(b))
    return F.when(b.isNull() | (a == b), one).otherwise(two)


def title(c: Column) -> Column:
    """Prepositions lower except at the start, articles only after a preposition; other words and acronyms stay."""
    w = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    low = F.transform(w, lambda x: F.lower(x))

    def one(x: Column, i: Column) -> Column:
        here, before = F.get(low, i), F.coalesce(F.get(low, i - 1), F.lit(""))
        small = here.isin(*PREPOSITIONS) | (here.isin(*ARTICLES) & before.isin(*PREPOSITIONS))
        acronym = (F.length(x) > 1) & (x == F.upper(x)) & (x != here)
        return F.when((i > 0) & small & ~acronym, here).otherwise(x)

    return F.array_join(F.transform(w, one), " ")


def shortened(c: Column, most: int = 280) -> Column:
    """The first whole sentences of the first paragraph that fit; a cut at a blank and an ellipsis if not even one does."""
    para = F.split_part(c, F.lit("\n"), F.lit(1))
    parts = F.split(para, r"""(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ¿¡“"])""")
    zero = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))

    def add(acc: Column, s: Column) -> Column:
        full = acc["full"] | (F.length(acc["t"]) + F.length(s) + 1 > most)
        return F.struct(F.when(full, acc["t"]).otherwise(F.trim(F.concat(acc["t"], F.lit(" "), s))).alias("t"), full.alias("full"))

    fit = F.aggregate(parts, zero, add)["t"]
    cut = F.concat(F.regexp_replace(F.substring(para, 1, most - 1), r" [^ ]*$", ""), F.lit("…"))
    return F.when(F.coalesce(c, F.lit("")) != "", F.when(F.length(para) <= most, para).when(fit != "", fit).otherwise(cut))


def spelling(c: Column) -> Column:
    """A folded word in one spelling for Quechua and Spanish."""
    for pattern, to in SPELLING:
        c = F.regexp_replace(c, pattern, to)
    return c


def token_set(c: Column, generic: tuple[str, ...] = ()) -> Column:
    """Sorted distinct words, folded, generic ones out, a plural s off words of over three letters."""
    w = F.regexp_extract_all(folded(c, keep_enye=False), F.lit(r"([a-z0-9]+)"), 1)
    w = F.transform(w, lambda x: F.when((F.length(x) > 3) & x.endswith("s"), F.regexp_replace(x, "s$", "")).otherwise(x))
    return F.array_sort(F.array_distinct(F.filter(w, lambda x: ~x.isin(*generic)) if generic else w))


def trip_request(c: Column) -> Column:
    """Struct (month, days, budget, origin) read from a sentence; null where it doesn't say."""
    t = folded(c, keep_enye=False)
    month = F.coalesce(*(F.when(t.rlike(rf"\b{m}\b") | (t.rlike(r"\bseptiembre\b") if i == 8 else F.lit(False)), F.lit(i + 1)) for i, m in enumerate(MONTHS)))
    number = lambda p: F.nullif(F.regexp_replace(F.regexp_extract(t, p, 1), r"[\s.,]", ""), F.lit(""))
    return F.struct(
        month.alias("month"),
        number(r"\b(\d{1,2})\s*dias?\b").cast("int").alias("days"),
        number(r"(?:\bs/\s*|\bpresupuesto (?:de |hasta )?|\bhasta s/\s*)(\d[\d .,]*)").cast("int").alias("budget"),
        F.nullif(F.regexp_extract(t, r"\bdesde ([a-z]+)", 1), F.lit("")).alias("origin"),
    )


def with_point(df: DataFrame, lat: str, lon: str, lat_range: tuple[float, float] = (-18.5, 0.1), lon_range: tuple[float, float] = (-81.5, -68.5)) -> DataFrame:
    """Adds point, a struct (lat, lon, state): correct, swapped, repaired (the decimal point of one value moved to the
    only place that fits), missing or invalid. Steps are columns, so that no expression is written out twice."""
    ranges = {"la": lat_range, "lo": lon_range}
    out = df.withColumn("_a", F.col(lat).cast("double")).withColumn("_b", F.col(lon).cast("double"))
    for v in ("_a", "_b"):
        out = out.withColumn(f"{v}_d", F.regexp_replace(F.regexp_replace(F.format_string("%.10f", F.abs(v)), r"\D", ""), "^0+", ""))
        for k in (1, 2):
            made = F.concat(F.substring(f"{v}_d", 1, k), F.lit("."), F.substr(f"{v}_d", F.lit(k + 1))).try_cast("double")
            out = out.withColumn(f"{v}_{k}", F.when(F.length(f"{v}_d") > k, F.signum(v) * made))
        for r, (low, high) in ranges.items():
            f1, f2 = (F.coalesce(F.col(f"{v}_{k}").between(low, high), F.lit(False)) for k in (1, 2))
            out = out.withColumn(f"{v}_{r}", F.when(f1 & ~f2, F.col(f"{v}_1")).when(f2 & ~f1, F.col(f"{v}_2")))
            out = out.withColumn(f"{v}_is_{r}", F.coalesce(F.col(v).between(low, high), F.lit(False)))
    c, none = F.col, F.lit(None).cast("double")
    point = lambda a, b, s: F.struct(a.alias("lat"), b.alias("lon"), F.lit(s).alias("state"))
    got = F.when(c("_a").isNull() | c("_b").isNull(), point(none, none, "missing")).when(c("_a_is_la") & c("_b_is_lo"), point(c("_a"), c("_b"), "correct")).when(c("_a_is_lo") & c("_b_is_la"), point(c("_b"), c("_a"), "swapped"))
    for a, b in (("_a", "_b"), ("_b", "_a")):
        got = got.when(c(f"{a}_is_la") & ~c(f"{b}_is_lo") & c(f"{b}_lo").isNotNull(), point(c(a), c(f"{b}_lo"), "repaired"))
        got = got.when(c(f"{b}_is_lo") & ~c(f"{a}_is_la") & c(f"{a}_la").isNotNull(), point(c(f"{a}_la"), c(b), "repaired"))
    return out.withColumn("point", got.otherwise(point(none, none, "invalid"))).select(*df.columns, "point")
