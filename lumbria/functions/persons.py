"""Persons named around contacts in notices: words by class, and spans of classes that are a person's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import folded, redacted

#: Words by class, folded. K announces a contact; T and O stand before a name, T is a part of it; L before a place's name;
#: M is written with a capital without being a name; S and A are words that are names and surnames too; P joins names.
WORDS: dict[str, tuple[str, ...]] = {
    "K": ("al", "cel", "celular", "tel", "telf", "telefono", "fono", "fijo", "movil", "numero", "nro", "whatsapp", "wsp", "correo", "email"),
    "T": ("sr", "sra", "srta", "senor", "senora", "senorita", "señor", "señora", "señorita", "don", "doña", "lic", "ing", "prof", "dr", "dra"),
    "O": ("encargado", "encargada", "responsable", "propietario", "propietaria", "dueño", "dueña", "administrador", "administradora", "presidente", "presidenta", "parroco", "padre", "familia", "guardian", "coordinador", "coordinadora", "jefe", "jefa", "director", "directora", "secretario", "secretaria", "guia", "contacto"),
    "L": ("catarata", "laguna", "lago", "rio", "cerro", "nevado", "bosque", "isla", "playa", "mirador", "fundo", "casa", "templo", "iglesia", "museo", "parque", "reserva", "caserio", "sector", "barrio", "calle", "jiron", "avenida", "pasaje"),
    "M": ("comunidad", "municipalidad", "gobierno", "gerencia", "oficina", "direccion", "asociacion", "empresa", "club", "centro", "distrito", "provincia", "region", "previa", "coordinar", "comunicarse", "contactar", "llamar", "reservas", "informes", "consultas", "visita", "visitas", "horario", "atencion", "entrada", "tarifa", "el", "la", "los", "las", "en", "con", "para", "por", "lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "enero", "febrero", "marzo", "junio", "agosto", "setiembre", "octubre", "noviembre", "diciembre"),
    "S": ("julio", "abril", "domingo", "santos", "rosa", "cruz", "luz", "angel", "san", "santa"),
    "A": ("mercado", "flora", "mayo"),
    "P": ("de", "del", "la", "las", "los", "y", "e"),
}
#: Tokens around a contact in which a name of a long text counts, and letters up to which a text is short.
BEFORE, BEHIND, SHORT = 40, 22, 400

_RUN = r"(?:[_.\-](?:P_){0,3}(?:[NSAL]|I(?=\.)))"
_TO_CONTACT = r"(?=[_.:\-x]?(?:K[_.:\-x]*){0,4}C)"
#: What spans of classes are a person: behind a title, the title too; behind an office; two names or more, one of which is
#: nothing else, and not a place's; one name right before a contact, with a word in small letters.
_PERSON = "|".join(
    (
        rf"T[_.:]{{1,2}}[NSALM]{_RUN}*",
        rf"(?<=O[_.:])[NS]{_RUN}*",
        rf"(?<!L_)(?=[NS][_.\-PSALI]*N|N)[NS]{_RUN}+",
        rf"(?<=L_)(?=[NS][_.\-PSALI]*N|N)[NS]{_RUN}{{2,}}",
        rf"(?<![NSALIPM]_)N(?:_w)??{_TO_CONTACT}",
    )
)


def _class(token: Column, behind: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """One letter for a token: of a word its class, w for any other; C a contact's mark; of a gap _ white space, a full
    stop, a dash, a colon for commas and the like, x what else there is."""
    low = folded(token)
    large = token.rlike(r"^\p{Lu}(?:\p{Ll}+|\p{Lu}+)$")
    known = lambda k: low.isin(*words[k])
    word = (
        F.when(F.length(token) == 1, F.when(token.rlike(r"^\p{Lu}") & behind.startswith("."), "I").when(known("P"), "P").otherwise("x"))
        .when(known("T"), "T").when(known("O"), "O").when(known("K"), "K").when(known("P"), "P")
        .when(~large, "w").when(known("S"), "S").when(known("A"), "A").when(known("L"), "L").when(known("M"), "M").otherwise("N")
    )
    gap = F.when(token.rlike(r"^[ \t]+$"), "_").when(token.rlike(r"^\. ?$"), ".").when(token.rlike(r"^ ?[-–] ?$"), "-").when(token.rlike(r"^\s*[.:,;]+\s*$"), ":").otherwise("x")
    return F.when(token.rlike(r"^\[\w+\]$"), "C").when(token.rlike(r"^\p{L}+$"), word).otherwise(gap)


def with_persons_redacted(df: DataFrame, text: str, out: str = "redacted", words: dict[str, tuple[str, ...]] | None = None, mark: str = "[name]") -> DataFrame:
    """Adds out: the text without e-mail addresses, numbers of phones and identity, and, where it holds any of these,
    without the names of persons around them, with or without a cue.

    The text is cut into words, gaps and contact marks, nothing lost, and each is a letter by its class; persons are
    spans of letters that _PERSON knows, read from the left, the longest first. In a text of over SHORT letters only
    spans near a contact count. A name after a place's word (Laguna Azul, Fundo Santa Rosa) stays, as does any text
    without a contact. words: classes in place of WORDS, which are few and meant to be extended. Null stays null.
    """
    w = WORDS | (words or {})
    tokens = F.regexp_extract_all("_t", F.lit(r"(\[\w+\]|\p{L}+|[^\p{L}\[]+|\[)"), 1)
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), redacted(F.col(f"`{text}`")).alias("_t"))
    own = own.withColumn("_w", tokens)
    own = own.withColumn("_c", F.array_join(F.transform("_w", lambda x, i: _class(x, F.coalesce(F.get("_w", i + 1), F.lit("")), w)), ""))
    near = rf"(?:(?=.{{0,{BEFORE}}}C)|(?<=C.{{0,{BEHIND}}}))"
    cut = lambda person: F.regexp_extract_all("_c", F.lit(rf"((?:{person})|.)"), 1)
    spans = F.when(F.length("_t") <= SHORT, cut(_PERSON)).otherwise(cut(f"{near}(?:{_PERSON})"))
    own = own.withColumn("_s", spans)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("o"))

    def add(acc: Column, s: Column) -> Column:
        single = (F.length(s) == 1) & ~_lone(acc["at"], s)
        piece = F.when(single, F.get("_w", acc["at"])).otherwise(F.lit(mark))
        return F.struct((acc["at"] + F.length(s)).alias("at"), F.concat(acc["o"], F.array(piece)).alias("o"))

    def _lone(at: Column, s: Column) -> Column:
        """A span of one letter is a person behind an office or before a contact."""
        rest, before = F.substr("_c", at + 1), F.substr("_c", F.greatest(at - 1, F.lit(1)), F.least(at, F.lit(2)))
        office = s.isin("N", "S") & before.rlike(r"^O[_.:]$")
        contact = (s == "N") & rest.rlike(rf"^N{_TO_CONTACT}") & ~before.rlike(r"^[NSALIPM]_$")
        within = (F.length("_t") <= SHORT) | rest.rlike(rf"^.{{0,{BEFORE}}}C") | F.substr("_c", F.greatest(at - BEHIND, F.lit(1)), F.least(at, F.lit(BEHIND + 1))).contains("C")
        return (office | contact) & within

    done = F.array_join(F.aggregate("_s", start, add)["o"], "")
    own = own.withColumn("_d", F.when(F.col("_c").contains("C"), done).otherwise(F.col("_t")))
    return own.select("row.*", F.col("_d").alias(out))
