"""Tariffs read from prose: amounts, the labels around them, and the rules that choose among them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import cleaned, folded

# How notices write amounts of soles, and the words that say whom or what an amount is for.
_NUMBER = r"(\d{1,4}(?:[.,]\d{1,2})?)"
_UNIT = r"(?:nuevos\s+)?(?:soles?|solos)\b"
AMOUNTS = (rf"s\s?\.?\s?/\s?\.?\s*{_NUMBER}(?:\s*{_UNIT})?", rf"{_NUMBER}\s*{_UNIT}", rf"{_NUMBER}\s*s\s?/\.?(?!\w)", r"(?<=\s)/\s?(\d{1,4}[.,]\d{2})(?!\d)")
LABELS = {
    "foreign": ("extranjer", r"no\s+residente", "internacional", r"\bext\b"),
    "national": ("nacional", "peruan", r"\bnac\b", "foraneo"),
    "local": (r"\blocal(?:es)?\b", "residente", "cusquen", "poblador", "comuner", r"region\s+\w+"),
    "adult": ("adult", "general", "publico", "persona", "visitante", "turista"),
    "reduced": ("ni[nñ][oa]", "menor", "escolar", "estudiant", "universitari", "jubilad", r"mayor(?:es)?\s+de", r"tercera\s+edad", "docente", "profesor", "conadis", "discapacidad", "militar", "reducid", "especial", "infant", "bebe", "joven", "colegio", "adolescente"),
    "vehicle": ("vehicul", "carro", r"\bauto", r"\bmoto", "estacionamiento", "parqueo", "cochera", r"unidad\s+movil"),
    "service": ("guia", "grupo", "delegaci", "camping", "campament", "carpa", "pernoct", "pernot", "bote", "paseo", "alquiler", "foto", "filmaci", "camara", r"\btour", "almuerzo", "hospedaje", "alojamiento", "noche", "caballo", "kayak", "lancha", "dron", "cuatrimoto", "canopy", "zip", "equipo", "chaleco", r"ruta\s+larga", "donaci", "colaboraci", "orientador", "hidromasaje", "sauna"),
}
NATIONAL_NAMES = r"\b(?:parque|reserva|santuario|museo|bosque|coto|refugio|patrimonio|monumento|biblioteca|teatro|universidad)\s+(?:historico\s+)?nacional\w*"
COMBINED = r"boleto\s+turistico|\bbtg\b|\bbtci\b|boleto\s+integral|boleto\s+parcial|circuito|incluid[oa]\s+en"
BARE_ADULT = r"adult\w*\s*:?\s*(\d{1,3}(?:[.,]\d{1,2})?)(?!\s*(?:\d|anos|años))"
#: Letters between a label and an amount, beyond which the label isn't the amount's.
NEAR = 25

_ANY = "|".join(w for words in LABELS.values() for w in words)
_OPEN, _SHUT = "\u0001", "\u0002"


def _head(context: Column) -> Column:
    """What follows an amount, up to the next separator."""
    return F.regexp_extract(context, r"(?s)^(.*?)(?:[,;/]|\s-\s|\sy\s|$)", 1)


def _labels(context: Column) -> Column:
    """Struct of a flag per label; names of places with 'nacional' in them say nothing, and older adults are pensioners."""
    c = F.regexp_replace(F.regexp_replace(context, NATIONAL_NAMES, " "), r"adultos?\s+mayor(?:es)?", "jubilado")
    return F.struct(*(c.rlike("|".join(words)).alias(k) for k, words in LABELS.items()))


def _before(context: Column) -> Column:
    """Letters between the last label's word and the amount behind it; 0 after a colon, null without a label."""
    rest = F.regexp_extract(context, rf"(?s)^.*(?:{_ANY})\w*?(?!\w)(.*)$", 1)
    return F.when(context.rlike(r"[:=]\s*$"), 0).when(context.rlike(_ANY), F.length(rest))


def _after(head: Column) -> Column:
    """Letters between an amount and the first label behind it, null without one."""
    return F.when(head.rlike(_ANY), F.length(F.regexp_extract(head, rf"(?s)^(.*?)(?:{_ANY})", 1)))


def _first(amounts: Column, rule) -> Column:
    return F.get(F.filter(amounts, rule), 0)["soles"]


def with_tariff(df: DataFrame, text: str, out: str = "tariff") -> DataFrame:
    """Adds out, a struct (soles, rule, combined): what a national adult pays by a notice, the rule that chose it, and
    whether the ticket holds for several places.

    Each amount has the words around it: those before it ("Adultos: S/ 11.00"), or, where the notice puts amounts first
    ("S/ 65.00 extranjeros y S/ 30.00 nacionales"), those behind it up to a comma, a slash, a dash or "y". Every amount
    votes for the side whose label is nearer, within NEAR letters; at a tie, amounts come first if the first one has a
    label behind it and none before. In this order, the first amount of:

    adult_national, an adult and national one; adult, for anyone; national, for any age, none of them reduced or for a
    vehicle or a service; only, the one amount, unless foreign, local, for a vehicle or a service; of several such ones
    max if one is reduced, as adults pay most, else min, as they are options; only_service, the one amount even if for a
    service; adult_bare, "Adultos: 10" where nothing is in soles. Dollars don't count. Without any, soles and rule are
    null; a null or empty cell gives nulls and false.
    """
    t = folded(F.coalesce(cleaned(F.col("_text")), F.lit("")))
    steps = [
        ("_t", F.regexp_replace(t, f"[{_OPEN}{_SHUT}]", "")),
        ("_m", F.regexp_replace("_t", "|".join(AMOUNTS), f"{_OPEN}$1$2$3$4{_SHUT}")),
        ("_v", F.transform(F.regexp_extract_all("_m", F.lit(f"{_OPEN}([^{_SHUT}]*){_SHUT}"), 1), lambda x: F.regexp_replace(x, ",", ".").try_cast("double"))),
        ("_c", F.split("_m", f"{_OPEN}[^{_SHUT}]*{_SHUT}")),
        ("_h", F.transform("_c", _head)),
        ("_d", F.transform("_c", lambda x: F.struct(_before(x).alias("b"), _after(_head(x)).alias("a")))),
    ]
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{text}`").alias("_text"))
    for name, c in steps:
        own = own.withColumn(name, c)
    near = lambda x: F.when(x <= NEAR, x)
    far = 1 << 30

    def vote(i: Column) -> Column:
        b, a = (F.coalesce(near(F.get("_d", i + k)[side]), F.lit(far)) for k, side in ((0, "b"), (1, "a")))
        return F.when(a < b, 1).when(b < a, -1).otherwise(0)

    every = F.when(F.size("_v") > 0, F.sequence(F.lit(0), F.size("_v") - 1)).otherwise(F.array().cast("array<int>"))
    votes = F.aggregate(F.transform(every, vote), F.lit(0), lambda s, x: s + x)
    tie = ~F.get("_c", F.lit(0)).rlike(_ANY) & F.coalesce(F.get("_h", F.lit(1)).rlike(_ANY), F.lit(False))
    own = own.withColumn("_first", F.when(votes != 0, votes > 0).otherwise(tie))
    own = own.withColumn("_a", F.transform(every, lambda i: F.struct(F.get("_v", i).alias("soles"), _labels(F.when(F.col("_first"), F.get("_h", i + 1)).otherwise(F.get("_c", i))).alias("l"))))
    a = F.col("_a")
    foreign = lambda x: x["l"]["foreign"] & ~x["l"]["national"]
    local = lambda x: x["l"]["local"] & ~x["l"]["national"]
    aside = lambda x: x["l"]["service"] | x["l"]["vehicle"]
    none = lambda *of: reduce(and_, (~x for x in of))
    chosen = [
        ("adult_national", _first(a, lambda x: x["l"]["adult"] & x["l"]["national"] & none(aside(x), x["l"]["reduced"], x["l"]["local"]))),
        ("adult", _first(a, lambda x: x["l"]["adult"] & none(foreign(x), local(x), aside(x), x["l"]["reduced"]))),
        ("national", _first(a, lambda x: x["l"]["national"] & none(x["l"]["reduced"], aside(x)))),
    ]
    own = own.withColumn("_good", F.filter(a, lambda x: none(foreign(x), local(x), aside(x))))
    good = F.col("_good")
    soles = F.transform(good, lambda x: x["soles"])
    one, some = F.size(a) == 1, F.size(good) > 0
    less = F.exists(good, lambda x: x["l"]["reduced"] & ~x["l"]["adult"])
    bare = F.regexp_replace(F.regexp_extract("_t", BARE_ADULT, 1), ",", ".").try_cast("double")
    chosen += [
        ("only", F.when(one & some, F.get(soles, 0))),
        ("max", F.when(some & less, F.array_max(soles))),
        ("min", F.when(some & ~less, F.array_min(soles))),
        ("only_service", F.when(one, _first(a, lambda x: x["l"]["service"] & none(x["l"]["vehicle"], foreign(x))))),
        ("adult_bare", F.when(F.size(a) == 0, bare)),
    ]
    found = F.filter(F.array(*(F.struct(c.alias("soles"), F.lit(k).alias("rule")) for k, c in chosen)), lambda x: x["soles"].isNotNull())
    best = F.get(found, 0)
    return own.withColumn("_b", best).select("row.*", F.struct(F.col("_b.soles").alias("soles"), F.col("_b.rule").alias("rule"), F.col("_t").rlike(COMBINED).alias("combined")).alias(out))
