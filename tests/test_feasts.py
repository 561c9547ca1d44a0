"""Dates of feasts by their context, typed cases; lists and ranges of one month."""

from pyspark.sql import functions as F

from lumbria.functions.dates import prose_rule
from lumbria.operators import feasts


def test_lists_and_same_month(spark):
    want = {
        "los días 28, 29 y 30 de junio": ("fija 06-28..06-30", "list"), "7,8,9 de noviembre": ("fija 11-07..11-09", "list"), "desde el 19 de mayo al 21 del mismo mes": ("fija 05-19..05-21", "same_month"),
        "30, 12 y 4 de mayo": ("fija 05-12..05-04", "range"), "el primero de agosto": ("fija 08-01", "day"), "el 1 de mayo, 2 de junio": ("fija 05-01", "day"),
    }
    d = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: tuple(r.v) for r in d.select("t", prose_rule(F.col("t")).alias("v")).collect()} == want


CASES = [
    ("Fundada el 3 de mayo de 1821. La fiesta se celebra el 24 de junio de cada año.", "fija 06-24", None),
    ("Está en la calle 3 de mayo. La festividad es el 8 de setiembre.", "fija 09-08", None),
    ("La fiesta va desde el 23 de enero hasta el 11 de febrero, siendo el día central el 2 de febrero.", "fija 01-23..02-11", "02-02"),
    ("La novena inicia el 6 de julio y el día central es el 15 de julio.", "fija 07-15", None),
    ("La fiesta inicia el 12 de agosto y culmina el 16 de agosto.", "fija 08-12..08-16", None),
    ("Procesión el 29 de diciembre; la fiesta concluye el 2 de enero.", "fija 12-29..01-02", None),
    ("Por resolución del 5 de junio de 2018 se le declaró patrimonio.", None, None),
    ("Mide 30 de largo y queda a 5 de marzo.", None, None),
    ("Se celebra el segundo domingo de mayo. En diciembre hay ensayos.", "nesimo 05 2 dom", None),
    ("El festival es del 5 al 9 de agosto; el 7 de agosto es el día central.", "fija 08-05..08-09", "08-07"),
    ("La fiesta fue el 4 de abril de 2022.", "fija 04-04", None),
    ("La fiesta fue el 4 de abril de 1969.", None, None),
    ("", None, None),
    (None, None, None),
    ("Nada", None, None),
]


def test_contexts(spark):
    d = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(CASES)], "id long, t string")
    rows = feasts.feast_dates(d, "id", "t").collect()
    got = {r.id: (r.rule, r.central_day) for r in rows}
    assert got == {k: (rule, day) for k, (_, rule, day) in enumerate(CASES) if rule}
    assert {r.id for r in rows if not r.exact} == {10}  # the date of one edition
    assert {r.id for r in feasts.feast_dates(d, "id", "t", old=F.lit(True)).collect()} >= {11}


def test_sections_are_weighed_together(spark):
    rows = [(1, "La fiesta es el 3 de mayo.", 0.0), (1, "La fiesta es el 4 de mayo.", 2.0), (2, "La fiesta es el 5 de mayo.", 1.0), (2, "La fiesta es el 5 de mayo.", 1.0), (None, "La fiesta es el 6 de mayo.", 0.0)]
    d = spark.createDataFrame(rows, "id long, t string, more double")
    assert {(r.id, r.rule) for r in feasts.feast_dates(d, "id", "t", "more").collect()} == {(1, "fija 05-04"), (2, "fija 05-05")}
    assert feasts.feast_dates(d.limit(0), "id", "t").count() == 0
