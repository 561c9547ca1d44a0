"""The date of a feast among all the dates that its texts name, weighed by what stands around each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import PROSE, plain_prose, prose_rule, rule_dates

# Words around a date, weights of what they say, and how far a text's dates belong together.
CELEBRATED = "celebr festej conmemor realiz desarroll culmina finaliza termina concluye clausura anualmente fiesta festividad festival procesion homenaje aniversario principal inicia empieza comienza vispera programa jubilar".split()
SECONDARY = "novena vispera preparativo ensayo inicia empieza comienza antevispera octava prolong".split()
ENDS = "culmina finaliza termina concluye clausura".split()
NO_FEAST = "calle avenida jiron pasaje urbanizacion plaza colegio institucion resolucion oficio ordenanza decreto ley informe carta fundad fundacion creacion creado creada declarad nacio murio falleci inaugur".split()
WEIGHTS = {"words": 3, "central": 6, "celebrated": 4, "yearly": 3, "secondary": -2}
KINDS = {"list": 2, "same_month": 2, "range_months": 2, "range": 2, "weekday": 1, "day": 0, "part": -1, "months": -2, "month": -2}
RECENT, TOGETHER, SOON = 2015, 45, 200

_CENTRAL = r"(?:dias?|fechas?)\s+(?:central|principal)(?:es)?\b|\bdia\s+de\s+fiesta\b"
_BEGIN, _END = "\u0001", "\u0002"


def _any(words: list[str]) -> str:
    return rf"\b(?:{'|'.join(words)})"


def mentions(texts: DataFrame, key: str, text: str, bonus: str | None = None) -> DataFrame:
    """(key, at, mention, before, after, more) of each date that each text names, in the folded text. Dates are marked by one
    pattern, the most exact first, so none is part of another; the text between two dates is what stands around them."""
    t = F.regexp_replace(plain_prose(F.col(text)), f"[{_BEGIN}{_END}]", " ")
    parts = F.split(F.regexp_replace(t, "|".join(f"(?:{p})" for p in PROSE.values()), f"{_BEGIN}$0{_END}"), _BEGIN)
    rows = texts.select(F.col(key), (F.col(bonus) if bonus else F.lit(0.0)).cast("double").alias("more"), parts.alias("_p")).where(F.size("_p") > 1)
    rest = lambda x: F.try_element_at(F.split(x, _END), F.lit(-1))
    ahead = F.transform("_p", lambda x, i: F.struct(F.when(i > 0, F.substring_index(x, _END, 1)).alias("mention"), rest(x).alias("after"), F.when(i > 0, rest(F.get("_p", i - 1))).alias("before"), F.length(F.regexp_replace(x, _END, "")).alias("n")))
    rows = rows.select(key, "more", ahead.alias("_p"))
    until = F.aggregate("_p", F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x["n"])))
    rows = rows.withColumn("_u", until).select(key, "more", F.posexplode("_p").alias("i", "m"), "_u").where("i > 0")
    return rows.select(key, "more", F.get("_u", F.col("i") - 1).alias("at"), "m.mention", F.substring(F.col("m.before"), -70, 70).alias("before"), "m.after")


def candidates(found: DataFrame, old: Column | None = None) -> DataFrame:
    """found with rule, kind, score, central, ends and the days it covers; without dates of history (a year before RECENT
    right after), of streets and decrees, or with no word of a feast around. old: for which rows history counts."""
    old = F.lit(False) if old is None else old
    b, a = F.col("before"), F.substring("after", 1, 60)
    near_b, near_a = F.regexp_extract(F.substring(b, -40, 40), r"(?:^|.*\. )(.*)$", 1), F.regexp_extract(a, r"^(.*?)(?:\. .*)?$", 1)
    year = F.nullif(F.regexp_extract(a, r"^\s*,?\s*del?\s+(?:ano\s+|año\s+)?(\d{4})\b", 1), F.lit("")).cast("int")
    words = F.size(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", b, F.substring(a, 1, 30)), F.lit(rf"{_any(CELEBRATED)}|\bcada\b|todos los a[nñ]os|\bdia del?\b|\bhonor\b|llev\w*\s+a\s+cabo"), 0)))
    said = F.regexp_extract(near_a, rf"^(.*?)(?:{_CENTRAL})", 1)
    central = near_b.rlike(_CENTRAL) | (near_a.rlike(_CENTRAL) & ~said.rlike(r"vispera|antes|previ|hasta|prepar|novena|\d"))
    rows = found.withColumn("_r", prose_rule(F.col("mention"))).select("*", "_r.rule", "_r.kind").drop("_r").where("rule IS NOT NULL")
    rows = rows.where(old | F.coalesce(year >= RECENT, F.lit(True))).where(old | ~b.rlike(rf"(?:{_any(NO_FEAST)}|\b(?:de|con) fecha\b|\b(?:av|jr|psje|urb|of)\.)[^.]{{0,20}}$"))
    rows = rows.withColumn("central", central).withColumn("_w", words).where("central OR _w > 0")
    w, kind = WEIGHTS, F.element_at(F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, float(v)))), F.col("kind"))
    score = (
        F.least("_w", F.lit(w["words"])) + w["central"] * F.col("central").cast("int") + w["celebrated"] * b.rlike(r"(?:se celebra|se festeja|se conmemora|celebrarse|cada)\s+(?:el\s+|los dias\s+|el dia\s+)?$").cast("int")
        + w["yearly"] * a.rlike(r"^\s*(?:de\s+)?(?:cada a[nñ]o|todos los a[nñ]os)").cast("int") + w["secondary"] * F.concat_ws(" ", near_b, F.substring(near_a, 1, 30)).rlike(rf"{_any(SECONDARY)}|hasta el").cast("int")
        + F.col("more") + kind - F.col("at") / 5000
    )
    span = rule_dates(F.col("rule"), F.lit(2024))  # a leap year
    exact = F.when(F.col("kind").isin("part", "months", "month") | (year >= RECENT), F.lit(False)).otherwise(True)
    ends = F.concat_ws(" ", b, F.substring(a, 1, 30)).rlike(rf"{_any(ENDS)}|hasta el|se extiende")
    rows = rows.withColumns({"score": score, "exact": F.coalesce(exact, F.lit(True)), "ends": ends, "fixed": F.col("rule").startswith("fija"), "_s": span})
    return rows.select(*found.columns, "rule", "kind", "score", "central", "exact", "ends", "fixed", F.col("_s.starts").alias("first"), F.col("_s.ends").alias("last"))


def feast_dates(texts: DataFrame, key: str, text: str, bonus: str | None = None, old: Column | None = None) -> DataFrame:
    """(key, rule, exact, central_day, score): a row per key some text of which names the date of a feast.

    texts: a row per text or section; the rows of a key are weighed together, bonus is what a section is worth. The best
    candidate counts, of equals the first. A day, or what the text calls the central days, within a longer range of at
    most TOGETHER days is the central day of that range; a range has the central day that falls into it; a day is
    continued to a later day that the same text, soon after, says it ends on. Null keys and texts give no rows.
    """
    rows = candidates(mentions(texts.where(F.col(key).isNotNull()), key, text, bonus), old)
    one = F.struct(F.col("score"), (-F.col("at")).alias("_o"), "at", "mention", "rule", "kind", "central", "exact", "ends", "fixed", "first", "last", "more")
    best = rows.groupBy(key).agg(F.max(one).alias("best"), F.collect_list(one).alias("every"))
    best = best.withColumn("every", F.sort_array("every", asc=False))
    x = F.col("best")
    single, plain = x["first"] == x["last"], F.regexp_replace(x["rule"], "^fija ", "")
    holds = lambda o: o["fixed"] & (o["rule"] != x["rule"]) & (o["first"] <= x["first"]) & (x["last"] <= o["last"]) & (F.datediff(o["last"], o["first"]) <= TOGETHER)
    around = F.filter("every", holds)
    around = F.coalesce(F.get(F.filter(around, lambda o: o["exact"]), F.lit(0)), F.get(around, F.lit(0)))
    within = F.get(F.filter("every", lambda o: o["central"] & o["fixed"] & (o["rule"] != x["rule"]) & (x["first"] <= o["first"]) & (o["last"] <= x["last"])), F.lit(0))
    gap = lambda o: o["at"] - x["at"] - F.length(x["mention"])
    later = lambda o: (o["kind"] == "day") & o["ends"] & (o["more"] == x["more"]) & (gap(o) > 0) & (gap(o) <= SOON) & (F.pmod(F.datediff(o["first"], x["first"]), F.lit(366)).between(1, TOGETHER))
    until = F.get(F.sort_array(F.transform(F.filter("every", later), lambda o: F.struct(o["at"], o["rule"]))), F.lit(0))["rule"]
    has_range = x["fixed"] & (single | x["central"]) & around.isNotNull()
    rule = F.when(has_range, around["rule"]).when((x["kind"] == "day") & until.isNotNull(), F.concat(x["rule"], F.lit(".."), F.regexp_replace(until, "^fija ", ""))).otherwise(x["rule"])
    day = F.when(has_range, plain).when(x["fixed"] & ~single, F.regexp_replace(within["rule"], "^fija ", ""))
    return best.select(key, rule.alias("rule"), x["exact"].alias("exact"), day.alias("central_day"), x["score"].alias("score"))
