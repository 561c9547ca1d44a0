"""Feasts of the parts, told in sections with other dates around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MONTHS
from ..operators import feasts
from .relational import T

c = F.col

#: By remainder of the key: {d} to {f} are days that the size makes, {m} and {o} months that the key makes, {n} the name.
_SECTIONS = (
    "{n}. Fundada el {e} de {o} de 1821. La fiesta se celebra el {d} de {m} de cada año.",
    "La fiesta va del {d} al {f} de {m}, siendo el día central el {e} de {m}. {n}",
    "{n} queda en la calle {d} de {m}, frente a la plaza {e} de {o}.",
    "{n}: festival los días {d}, {d1} y {d2} de {m}",
    "La fiesta inicia el {d} de {m} y culmina el {f} de {m}. {n}",
    "Hay ensayos en {o}. Se celebra la festividad el segundo domingo de {m}. {n}",
    "La novena inicia el {d} de {m} y el día central es el {f} de {m}. {n}",
)


def sections(s: SparkSession, d: str) -> DataFrame:
    """(part, text, more): what each part's notes say, and for every third part a description that names another day."""
    months = F.array(*map(F.lit, MONTHS))
    day, k = c("p_size") % 15 + 1, c("p_partkey")
    put = {"d": day, "d1": day + 1, "d2": day + 2, "e": day + 4, "f": day + 9, "m": F.element_at(months, (k % 12 + 1).cast("int")), "o": F.element_at(months, ((k + 5) % 12 + 1).cast("int")), "n": c("p_name")}
    said = None
    for r, text in enumerate(_SECTIONS):
        piece = F.lit(text)
        for name, value in put.items():
            piece = F.replace(piece, F.lit(f"{{{name}}}"), value.cast("string"))
        said = F.when(k % 7 == r, piece) if said is None else said.when(k % 7 == r, piece)
    p = T(s, d, "part")
    other = F.concat(F.lit("El aniversario es el "), (day + 12).cast("string"), F.lit(" de "), put["m"], F.lit("."))
    notes = p.select(k.alias("part"), said.alias("text"), F.lit(2.0).alias("more"))
    return notes.unionByName(p.where(k % 3 == 0).select(k.alias("part"), other.alias("text"), F.lit(1.0).alias("more")))


_SQL = """WITH p AS (SELECT p_partkey AS part, p_partkey % 7 AS r, p_partkey % 3 = 0 AS twice, p_size % 15 + 1 AS d, lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') AS m FROM part),
q AS (SELECT *, m || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS d0, m || '-' || lpad(CAST(d + 2 AS VARCHAR), 2, '0') AS d2, m || '-' || lpad(CAST(d + 4 AS VARCHAR), 2, '0') AS e, m || '-' || lpad(CAST(d + 9 AS VARCHAR), 2, '0') AS f, m || '-' || lpad(CAST(d + 12 AS VARCHAR), 2, '0') AS g FROM p)
SELECT part, CASE r WHEN 0 THEN 'fija ' || d0 WHEN 1 THEN 'fija ' || d0 || '..' || f WHEN 2 THEN 'fija ' || g WHEN 3 THEN 'fija ' || d0 || '..' || d2 WHEN 4 THEN 'fija ' || d0 || '..' || f WHEN 5 THEN 'nesimo ' || m || ' 2 dom' ELSE 'fija ' || f END AS rule, CASE WHEN r = 1 THEN e END AS central_day FROM q WHERE r <> 2 OR twice"""

QUERIES = {"F25_feast_dates": (lambda s, d: feasts.feast_dates(sections(s, d), "part", "text", "more").select("part", "rule", "central_day"), _SQL)}
