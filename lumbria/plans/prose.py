"""Parsers of prose over sentences that the tables' own names and numbers make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.persons import with_persons_redacted
from ..functions.tariffs import with_tariff
from .relational import T

c = F.col

#: Notices by remainder of the part's key; {a} to {c} are its size, its size and two, and the hundredths of its price.
_NOTICES = (
    "Adultos nacionales S/ {a}.50, adultos extranjeros S/ {b}.00, {n}",
    "Extranjeros: S/ {b}.00; estudiantes: S/ {c},50; adultos: S/ {a}.00 {n}",
    "S/ {b}.00 extranjeros y S/ {a}.20 nacionales; {n}",
    "{n}: entrada S/. {a}",
    "{n}. Entrada S/ {a}, niños S/ {b}",
    "{a} soles la poza, {b} soles la piscina, {n}",
    "Paseo en bote: S/ {a}.00, {n}",
    "Costo adultos: {a}, {n}",
    "Estacionamiento: S/ {a}.00, {n}",
    "Boleto Turístico {n}: público en general {a}.00 s/., niños {c}.00 s/.",
)


def _tariffs(s: SparkSession, d: str) -> DataFrame:
    filled = F.get(F.array(*map(F.lit, _NOTICES)), (c("p_partkey") % len(_NOTICES)).cast("int"))
    for mark, v in {"{a}": c("p_size"), "{b}": c("p_size") + 2, "{c}": F.floor(c("p_retailprice")) % 100, "{n}": F.initcap("p_name")}.items():
        filled = F.replace(filled, F.lit(mark), v.cast("string"))
    t = with_tariff(T(s, d, "part").select("p_partkey", filled.alias("notice")), "notice")
    return t.select("p_partkey", "tariff.soles", "tariff.rule", "tariff.combined")


_TARIFFS = """SELECT p_partkey, CAST(CASE p_partkey % 10 WHEN 0 THEN a + 0.5 WHEN 1 THEN a WHEN 2 THEN a + 0.2 WHEN 3 THEN a WHEN 4 THEN greatest(a, a + 2) WHEN 5 THEN least(a, a + 2) WHEN 6 THEN a WHEN 7 THEN a WHEN 9 THEN a END AS DOUBLE) AS soles,
CASE p_partkey % 10 WHEN 0 THEN 'adult_national' WHEN 1 THEN 'adult' WHEN 2 THEN 'national' WHEN 3 THEN 'only' WHEN 4 THEN 'max' WHEN 5 THEN 'min' WHEN 6 THEN 'only_service' WHEN 7 THEN 'adult_bare' WHEN 9 THEN 'adult' END AS rule,
p_partkey % 10 = 9 AS combined FROM (SELECT p_partkey, p_size AS a FROM part)"""

#: Names that keys choose from, and notices about them; {n} a name, {k} a number, {w} the part's own name.
_FIRST, _LAST = ("Pablo", "Marta", "Elena", "Ricardo", "Teresa", "Hugo", "Nilda"), ("Quispe", "Mamani", "Huaman", "Condori", "Paredes")
_ABOUT = (
    "Previa coordinación con {n} al Cel. {k}, {w}",
    "{w}: llamar al {k}, {n}",
    "Informes {k} - {n} atiende la {w}",
    "El guardián {n} abre; {w}, telf. {k}",
    "Laguna Azul, {w}, reservas al {k}",
    "Libro de {n} sobre {w}",
)


def _persons(s: SparkSession, d: str) -> DataFrame:
    pick = lambda words, key: F.get(F.array(*map(F.lit, words)), (key % len(words)).cast("int"))
    k = c("p_partkey")
    name = F.concat_ws(" ", pick(_FIRST, k), pick(_LAST, F.floor(k / 3)), F.when(k % 4 == 0, pick(_LAST, F.floor(k / 11))))
    t = pick(_ABOUT, k)
    for mark, v in {"{n}": name, "{k}": (900_000_000 + k).cast("string"), "{w}": c("p_name")}.items():
        t = F.replace(t, F.lit(mark), v)
    return with_persons_redacted(T(s, d, "part").select("p_partkey", t.alias("t")), "t").select("p_partkey", "redacted")


_SAID = ", ".join("'" + x.replace("{k}", "[phone]").replace("{n}", "{n}" if x.startswith("Libro") else "[name]") + "'" for x in _ABOUT)
_OWN = "concat_ws(' ', [{f}][p_partkey % 7 + 1], [{l}][p_partkey // 3 % 5 + 1], CASE WHEN p_partkey % 4 = 0 THEN [{l}][p_partkey // 11 % 5 + 1] END)".format(f=", ".join(f"'{x}'" for x in _FIRST), l=", ".join(f"'{x}'" for x in _LAST))

QUERIES = {
    "F4_persons": (_persons, f"SELECT p_partkey, replace(replace([{_SAID}][p_partkey % 6 + 1], '{{w}}', p_name), '{{n}}', {_OWN}) AS redacted FROM part"),
    "F9_tariffs": (_tariffs, _TARIFFS),
}
