"""Persons in notices: cases, and precision and recall on planted names."""

import random

from lumbria.functions.persons import with_persons_redacted

CASES = [
    ("Previa coordinación con el Sr. Fulano Mengano al Cel. 987654321", "Previa coordinación con el [name] al Cel. [phone]"),
    ("Coordinar previamente con Fulano Mengano Zutano - Cel.: 987654321.", "Coordinar previamente con [name] - Cel.: [phone]."),
    ("reservas: Fulana Mengana-987654321 – Zutano Perengano - 912345678.", "reservas: [name]-[phone] – [name] - [phone]."),
    ("Comunicarse al 987654321 - Fulano Mengano o 912345678 Zutano Perengano.", "Comunicarse al [phone] - [name] o [phone] [name]."),
    ("con el propietario Fulano Mengano al contacto 987654321", "con el propietario [name] al contacto [phone]"),
    ("contactar con el sr. Julio Mengano, celular 987654321", "contactar con el [name], celular [phone]"),
    ("El párroco Fulano atiende de lunes a viernes. Cel. 987654321", "El párroco [name] atiende de lunes a viernes. Cel. [phone]"),
    ("Director Fulano Mercado Mengano / Cel.: 987654321", "Director [name] / Cel.: [phone]"),
    ("el padre Fulano Mengano- Zutano, cuyo teléfono es el 987654321", "el padre [name], cuyo teléfono es el [phone]"),
    ("Lic. María de la Cruz Zutano 987654321", "[name] [phone]"),
    ("Fulano J. Mengano 987654321", "[name] [phone]"),
    ("Paseos en bote Fulana (cel: 987654321)", "Paseos en bote [name] (cel: [phone])"),
    ("Laguna Azul, informes al 987654321", "Laguna Azul, informes al [phone]"),
    ("Fundo Santa Rosa. Cel. 987654321", "Fundo Santa Rosa. Cel. [phone]"),
    ("Municipalidad de Huayhuay - Cel. 987654321", "Municipalidad de Huayhuay - Cel. [phone]"),
    ("escrito por Fulano Mengano, en español", "escrito por Fulano Mengano, en español"),
    ("[nota] sin contacto de Fulano Mengano", "[nota] sin contacto de [name]"),
    ("", ""),
    (None, None),
]


def test_cases(spark):
    rows = [(k, t, "x") for k, (t, _) in enumerate(CASES)]
    got = {r.id: r.redacted for r in with_persons_redacted(spark.createDataFrame(rows, "id int, t string, _w string"), "t").collect()}
    assert [(CASES[k], v) for k, v in sorted(got.items()) if v != CASES[k][1]] == [] and len(got) == len(CASES)


def test_only_names_near_a_contact_in_long_texts(spark):
    far = "Obra de Pablo Quispe. " + "una frase larga de relleno que no dice nada más. " * 20
    t = with_persons_redacted(spark.createDataFrame([(far + "Llamar a Pablo Quispe: 987654321",)], "t string"), "t").first().redacted
    assert t == far + "Llamar a [name]: [phone]"


def test_precision_and_recall(spark):
    r = random.Random(11)
    first = "Pablo Marta Elena Ricardo Teresa Hugo Nilda Oscar Yolanda Edgar".split()
    last = "Quispe Mamani Huaman Condori Flores Vargas Chávez Ñahui Paredes Soto".split()
    places = ["Laguna Parón", "Museo Larco", "Cerro Baúl", "Isla Amantaní", "Catarata Gocta", "Iglesia San Pedro"]
    shapes = ["Coordinar con {n} al {p}", "{n} ({p}) atiende en {l}", "Visita a {l}: llamar al {p}, {n}", "Informes con el guardián {n} - {p}", "{l}. Reservas al {p}", "Escribir a {p}; {l} abre los lunes", "Comunicarse con {n}, telf. {p}, para {l}"]
    rows, named, kept = [], 0, 0
    for k in range(400):
        n = f"{r.choice(first)} {r.choice(last)}" + (f" {r.choice(last)}" if r.random() < 0.4 else "")
        s = r.choice(shapes)
        place = r.choice(places)
        rows.append((k, s.format(n=n, p=f"9{r.randrange(10**8):08d}", l=place), s.format(n="[name]", p="[phone]", l=place)))
    got = with_persons_redacted(spark.createDataFrame(rows, "id int, t string, want string"), "t").collect()
    planted = sum("[name]" in x.want for x in got)
    named = sum("[name]" in x.want and "[name]" in x.redacted for x in got)
    marks = sum(x.redacted.count("[name]") for x in got)
    kept = sum(x.redacted == x.want for x in got)
    assert named >= 0.95 * planted and sum(x.want.count("[name]") for x in got) >= 0.95 * marks and kept >= 0.9 * len(got)
