"""Bands at their edges, nested places, sessions, and CSV files of unlike encodings read where their blocks are."""

import datetime

from pyspark.sql import functions as F

from lumbria.functions import bands
from lumbria.plans import bands as plan
from lumbria.sources import files
from lumbria.streaming import log


def test_edges(spark):
    values = [None, float("nan"), -1.0, 0.0, 0.29, 0.3, 2.0, 10.0, 10.5, 20.0, 499.9, 500.0, 2000.0, 2000.1]
    v = F.col("v")
    d = spark.createDataFrame([(x,) for x in values], "v double")
    got = d.select(bands.band(v, (10, 20)).alias("a"), bands.band(v, (10, 20), from_edge=False).alias("b"), bands.range_label(v, bands.WAY_KM).alias("w"), bands.sky_class(v).alias("s"), bands.town_band(v).alias("t")).collect()
    assert [r.a for r in got] == [None, None, 0, 0, 0, 0, 0, 1, 1, 2, 2, 2, 2, 2]
    assert [r.b for r in got] == [None, None, 0, 0, 0, 0, 0, 0, 1, 1, 2, 2, 2, 2]
    assert [r.w for r in got] == [None, None, None, None, "0-10 km", "0-10 km", "0-10 km", "0-10 km", "10-30 km", "10-30 km", "300-2000 km", "300-2000 km", "300-2000 km", None]
    assert [r.s for r in got][:7] == [None, None, "very dark", "very dark", "very dark", "dark", "lit"]
    assert [r.t for r in got] == [0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 3, 3]


def test_places_read_only_what_they_need(spark, small, tmp_path):
    path = plan.places(spark, small)
    got = files.read_places(spark, path, plan.KINDS)
    text = got._jdf.queryExecution().executedPlan().toString()
    schema = next(x for x in text.splitlines() if "ReadSchema" in x)
    assert "common" not in schema and "xmax" not in schema and "dataset" not in schema and "primary" in schema and "GreaterThanOrEqual(confidence,0.7)" in text
    assert 0 < got.count() < spark.read.parquet(path).count()
    odd = [("a", None, "k", 0.7, None, [("x", "CDLA-1", "1")]), ("b", ("n", None), "k", None, None, [("x", "CDLA-1", "1")]), ("c", ("n", None), "k", 0.9, None, None), ("d", ("n", None), "k", 0.9, None, [("x", "CDLA-1", "1"), ("y", None, "2")]), ("e", ("n", None), None, 0.9, None, [("x", "CDLA-1", "1")])]
    spark.createDataFrame(odd, files.PLACE).write.parquet(f"{tmp_path}/odd")
    assert [(r.id, r.name, r.lat) for r in files.read_places(spark, f"{tmp_path}/odd", ["k"]).collect()] == [("a", None, None)]


def test_sessions(spark):
    t = datetime.datetime(2024, 5, 1, 10)
    at = lambda m: t + datetime.timedelta(minutes=m)
    d = spark.createDataFrame([(1, at(0)), (1, at(29)), (1, at(200)), (2, at(5)), (None, at(6))], "who long, ts timestamp")
    by_id = {(r.who, r.starts, r.ends, r.n) for r in log.by_session(d, "who", "ts").collect()}
    assert by_id == {(1, at(0), at(200), 3), (2, at(5), at(5), 1)}
    assert {(r.who, r.starts, r.n) for r in log.by_pause(d, "who", "ts").collect()} == {(1, at(0), 2), (1, at(200), 1), (2, at(5), 1)}
    assert log.by_session(d.limit(0), "who", "ts").count() == log.by_pause(d.limit(0), "who", "ts").count() == 0


def test_sniffed(spark, tmp_path):
    odd = [
        ("a.csv", "k;name\n1;ñandú, x\n2;\n3\n4;y;z\n".encode("cp1252")),
        ("b.csv", "﻿name,k\n\"two\nlines\",5\nñ,6\n".encode()),
        ("c c.csv", "k\tname\r\n7\tq\r\n".encode()),
        ("d.csv", b""),
        ("e.csv", b"k;name\n"),
        ("f.csv", "k;name\n8;ñ\n".encode()),
    ]
    for name, raw in odd:
        (tmp_path / name).write_bytes(raw)
    rows = files.read_sniffed(spark, f"{tmp_path}/*.csv").collect()
    got = {(r.file.replace("%20", " "), r.cells.get("k"), r.cells.get("name")) for r in rows}
    assert {x for x in got if x[1] not in ("2", "3", "4")} == {("a.csv", "1", "ñandú, x"), ("b.csv", "5", "two\nlines"), ("b.csv", "6", "ñ"), ("c c.csv", "7", "q"), ("f.csv", "8", "ñ")}
    assert {r.cells["k"]: r.odd for r in rows if r.odd} == {"3": "3", "4": "4;y;z"} and len(rows) == 8
    places = [r.place for r in rows if r.file == "a.csv"]
    assert places == sorted(places)


def test_a_large_file_is_split(spark, tmp_path):
    n = 60_000
    (tmp_path / "large.csv").write_bytes(b"k;name\n" + b"".join(b"%d;\xf1and\xfa\n" % k for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = files.read_sniffed(spark, f"{tmp_path}/*.csv", quoted_lines=False)
        assert got.rdd.getNumPartitions() > 4
        assert got.agg(F.count(F.lit(1)), F.sum(F.col("cells.k").cast("long")), F.count_distinct("cells.name"), F.count("odd")).first()[:] == (n, n * (n - 1) // 2, 1, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
