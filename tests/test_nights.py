"""Night plans: odd trips, and the order in which nights are given away."""

import datetime

from lumbria.operators import nights

DAY = datetime.date(2027, 7, 3)  # a Saturday
TRIP = "trip long, zone long, arrives int, leaves int, start date, out boolean, stars boolean, high boolean"
ZONES = [(1, True, 0.9), (2, False, 0.1), (3, True, None)]
SHOWS = [(1, 10, 50, None), (1, 11, 20, [6, 0]), (3, 12, 61, None), (2, 13, 5, None)]


def planned(spark, *trips, dark=()):
    z = spark.createDataFrame(ZONES, "zone long, venues boolean, clear double")
    s = spark.createDataFrame(SHOWS, "zone long, id long, minutes int, days array<int>")
    d = spark.createDataFrame([*dark], "zone long, day date, hours double")
    rows = nights.night_plans(spark.createDataFrame(trips, TRIP), z, s, d).collect()
    return {(r.trip, r.night): r.kind if r.show is None else (r.kind, r.show) for r in rows}


def test_kinds(spark):
    dark = [(1, DAY + datetime.timedelta(k), h) for k, h in enumerate((3.0, 9.0, 9.0, 1.0))]
    got = planned(
        spark,
        (1, 1, 1, 5, DAY, True, True, True),  # rest, the show on Sunday, of nights 3 and 4 the darker one
        (2, 1, 1, 4, None, False, True, False),  # no date: the show on the second night, so the stars on the first
        (3, 2, 1, 3, None, True, True, True),  # no venues, few clear nights: only the show
        (4, 3, 1, 3, None, True, True, False),  # the show is too far; clear nights unknown
        (5, 1, 2, 3, DAY, False, True, False),  # one night, and the show takes it: the stars come before it
        (6, 1, 3, 3, DAY, True, True, True),
        (7, 4, 1, 3, None, True, None, None),
        (8, 1, 1, 2, None, None, None, None),
        dark=dark,
    )
    assert got == {
        (1, 1): "rest", (1, 2): ("show", 11), (1, 3): "stars", (1, 4): "out", (2, 1): "stars", (2, 2): ("show", 11), (3, 2): ("show", 13),
        (4, 1): "out", (4, 2): "stars", (5, 2): "stars", (8, 1): ("show", 11),
    }


def test_no_trips(spark):
    assert planned(spark, (1, None, None, None, None, None, None, None)) == {}
