"""The versioned table: atomic puts, scans at a version, incremental reading, restarts, failures, bounds."""

import pytest
from pyspark.sql import functions as F

from lumbria.session import scratch
from lumbria.streaming.log import landed
from lumbria.streaming.versions import Full, Reader, Versioned

KIND = "id long, v string, ends int"


@pytest.fixture
def table(spark):
    return Versioned(spark, scratch(spark, "versioned"), KIND, ["id"])


def rows(spark, *of):
    return spark.createDataFrame(list(of), KIND)


def held(df):
    return sorted(map(tuple, df.collect()))


def test_put_scan_delete(spark, table):
    assert table.marker() == 0 and held(table.scan()) == [] and held(table.since(0)) == []
    assert table.put(rows(spark, (1, "a", 1), (2, "b", 1))) == 1
    assert table.put(rows(spark, (2, "c", 1), (3, None, None))) == 2
    assert table.delete(rows(spark, (1, None, None)).select("id")) == 3
    assert held(table.scan()) == [(2, "c", 1), (3, None, None)] and held(table.scan(1)) == [(1, "a", 1), (2, "b", 1)]
    assert held(table.since(1)) == [(1, None, None, True), (2, "c", 1, False), (3, None, None, False)]
    assert table.snapshot() == 4 and held(table.scan()) == [(2, "c", 1), (3, None, None)] and held(table.since(3)) == []
    table.put(rows(spark, (2, "d", 1)))
    assert held(table.scan()) == [(2, "d", 1), (3, None, None)] and held(table.since(4)) == [(2, "d", 1, False)]


def test_a_write_that_fails_is_never_seen(spark, table):
    table.put(rows(spark, (1, "a", 1)))
    bad = rows(spark, (2, "b", 1)).withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        table.put(bad)
    assert table.marker() == 1 and held(table.scan()) == [(1, "a", 1)]


def test_two_writers_take_two_versions(spark, table, monkeypatch):
    other = Versioned(spark, table.path, KIND, ["id"])
    seen = table.marker

    def late():
        n = seen()
        monkeypatch.setattr(table, "marker", seen)
        other.put(rows(spark, (5, "other", 1)))
        return n

    monkeypatch.setattr(table, "marker", late)
    assert table.put(rows(spark, (6, "own", 1))) == 2
    assert held(table.scan()) == [(5, "other", 1), (6, "own", 1)]


def test_batches_are_put_once(spark, table):
    src = rows(spark, *((k, f"v{k}", 1) for k in range(40)))
    table.follow(landed(src, "rows", 4, 1), scratch(spark, "state"))
    assert table.marker() == 4 and held(table.scan()) == held(src)
    assert table.put(rows(spark, (1, "x", 1)), once="s:1") == 5 and table.put(rows(spark, (1, "y", 1)), once="s:1") == 5
    assert ("x",) in {(r[1],) for r in held(table.scan())}


def test_bound_of_rows_to_come(spark, table):
    future = F.col("ends") >= 10
    table.put(rows(spark, (1, "a", 10), (2, "b", 9)), future=future, most=2)
    table.put(rows(spark, (3, "c", 11)), future=future, most=2)
    with pytest.raises(Full):
        table.put(rows(spark, (4, "d", 12)), future=future, most=2)
    table.put(rows(spark, (3, "corrected", 12), (5, "past", 1)), future=future, most=2)
    table.put_some(rows(spark, (1, "again", 10), (6, "x", 20), (7, "y", 15), (8, "past", 2), (9, "no end", None)), future, ["ends"], most=3)
    assert held(table.scan()) == [(1, "again", 10), (2, "b", 9), (3, "corrected", 12), (5, "past", 1), (7, "y", 15), (8, "past", 2), (9, "no end", None)]


def test_reader_keeps_the_last_good_version(spark, table, monkeypatch):
    now = [100.0]
    reader = Reader(table, clock=lambda: now[0])
    table.put(rows(spark, (1, "a", 1)))
    assert reader.current()[0] == 1
    table.put(rows(spark, (2, "b", 1)))
    now[0] += 1
    assert reader.current()[0] == 1  # too soon to look
    now[0] += 2
    assert reader.current()[0] == 2 and len(held(reader.rows)) == 2
    table.put(rows(spark, (3, "c", 1)))
    good = Versioned.scan
    monkeypatch.setattr(Versioned, "scan", lambda *a: (_ for _ in ()).throw(OSError("no disk")))
    now[0] += 3
    version, kept = reader.current()
    assert version == 2 and len(held(kept)) == 2
    monkeypatch.setattr(Versioned, "scan", good)
    now[0] += 5
    assert reader.current()[0] == 2  # waits before it tries again
    now[0] += 6
    assert reader.current()[0] == 3
    now[0] -= 1000  # the clock was set back
    assert reader.current()[0] == 3 and len(held(reader.rows)) == 3
