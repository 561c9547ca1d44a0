"""Rows that every dealt operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "the of and a to in is you that it he was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


SHARED = prose(80, 1)
ROWS = [
    (1, "Hello World, this is one line\nand a second line of it\nshort"),
    (2, "hello world, this is one line\nand a second line of it\nshort"),
    (3, None),
    (4, ""),
    (5, "\n\n  \n"),
    (6, prose(120, 2) + " " + SHARED + " " + prose(30, 3)),
    (7, prose(50, 4) + " " + SHARED),
    (8, prose(4000, 5)),
    (9, prose(4000, 5) + " tail"),
    (10, "Ñandú AÑO É ünï\x00code   日本語 😀 text with more than ten points"),
    (11, "ñandú aÑO É ünï\x00code   日本語 😀 text with more than ten points"),
    (12, "Ñandú aÑO É ünï\x00code   日本語 😀 text with more than ten points"),
    (13, "aaaaaaaaaa" * 60),
    (13, "aaaaaaaaaa" * 60),
    (14, "x"),
    (15, "x"),
    (16, "X"),
    (17, prose(120, 2)),
    (18, prose(120, 2).replace("the", "THE")),
    (None, "a row without an id, but with a line that is shared"),
    (19, "a row without an id, but with a line that is shared"),
    (20, " \t tab first line here\n\tTAB FIRST LINE HERE \r\n"),
]


def docs(spark, rows=ROWS):
    """With extra columns under names that operators might use themselves."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, key long, sha string, component_id long, drop string"
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), 1, "s", 5, None) for i, t in rows], kind)


def empty(spark):
    return docs(spark, [])


def ids(rows=ROWS):
    return [2**63 - 1 if i is None else i for i, _ in rows]
