"""Tariffs from notices: each rule, the ties between sides, and what doesn't count."""

from lumbria.functions.tariffs import with_tariff

CASES = [
    ("Adultos nacionales S/ 10.00, adultos extranjeros S/ 20.00", 10, "adult_national"),
    ("Extranjeros: S/ 40.00; adulto nacional: S/ 12,50; niños: S/ 3", 12.5, "adult_national"),
    ("S/ 65.00 extranjeros y S/ 30.00 nacionales", 30, "national"),
    ("Adultos: S/ 11.00, estudiantes: S/ 6.00, niños: S/ 1.00", 11, "adult"),
    ("5 nuevos soles adultos, 2 soles menores", 5, "adult"),
    ("Público en general 4.00 s/., escolares 1.00 s/.", 4, "adult"),
    ("adulto /12.00 niños /6.00", 12, "adult"),
    ("Adultos mayores: S/ 3.00 - Nacionales: S/ 8.00", 8, "national"),
    ("Boleto del Museo Nacional: S/ 7.00", 7, "only"),
    ("Entrada S/ 5", 5, "only"),
    ("Entrada S/ 5, niños S/ 2", 5, "max"),
    ("Poza S/ 4.00, piscina S/ 6.00", 4, "min"),
    ("Paseo en bote: S/ 15.00", 15, "only_service"),
    ("Estacionamiento: S/ 5.00", None, None),
    ("Extranjeros: S/ 50.00", None, None),
    ("Pobladores locales: S/ 1.00", None, None),
    ("Costo adultos: 10, estudiantes: 5", 10, "adult_bare"),
    ("Adultos de 18 años", None, None),
    ("Pagan US$ 10 los extranjeros", None, None),
    ("S/ 8.00 por persona, S/ 20.00 por vehículo", 8, "adult"),
    ("Vehículos: S/ 20.00 / Personas: S/ 8.00", 8, "adult"),
    ("Locales S/ 2.00, nacionales S/ 5.00, extranjeros S/ 10.00", 5, "national"),
    ("--", None, None),
    ("", None, None),
    (None, None, None),
]


def test_rules(spark):
    rows = [(k, t, "x") for k, (t, _, _) in enumerate(CASES)]
    got = with_tariff(spark.createDataFrame(rows, "id int, notice string, _v string"), "notice").collect()
    assert got[0]._v == "x"
    wrong = [(CASES[r.id], r.tariff) for r in got if (r.tariff.soles, r.tariff.rule) != CASES[r.id][1:]]
    assert not wrong and len(got) == len(CASES)


def test_combined_tickets(spark):
    rows = [("Incluido en el Circuito de la ciudad. Adultos S/30, estudiantes S/ 15",), ("Boleto turístico",), ("Adultos S/ 4",), (None,)]
    got = [tuple(r.tariff) for r in with_tariff(spark.createDataFrame(rows, "t string"), "t").collect()]
    assert got == [(30.0, "adult", True), (None, None, True), (4.0, "adult", False), (None, None, False)]


def test_order_of_equals(spark):
    """The first of several amounts of a rule; several bare amounts the least."""
    rows = [("Adultos: S/ 9.00, público en general: S/ 7.00",), ("S/ 9.00, S/ 7.00",), ("S/ 3.00 adultos, S/ 3.00 nacionales",)]
    got = [tuple(r.tariff)[:2] for r in with_tariff(spark.createDataFrame(rows, "t string"), "t").collect()]
    assert got == [(9.0, "adult"), (7.0, "min"), (3.0, "adult")]
