"""Readers and writers for the file kinds of the pipeline; paths are anything that Spark reads."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumns(ValueError):
    pass


class DuplicateKeys(ValueError):
    pass


def _allow(spark: SparkSession, encoding: str) -> None:
    """Spark takes other Java charsets, such as windows-1252, only with this setting, which a lazy read still needs."""
    if encoding.lower() not in {"iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, key: list[str] | None = None, sep: str = ";", encoding: str = "utf-8") -> DataFrame:
    """A headed CSV by column name, whatever their order; a BOM is ignored. Columns that the header lacks and repeated
    keys are errors."""
    _allow(spark, encoding)
    raw = spark.read.csv(path, sep=sep, encoding=encoding, header=True, multiLine=True, quote='"', escape='"')
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    if missing := [f.name for f in schema if f.name not in names]:
        raise MissingColumns(", ".join(missing))
    out = raw.select(*(F.nullif(F.trim(F.col(f"`{names[f.name]}`")), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema))
    if key and not out.groupBy(*key).count().where("count > 1").isEmpty():
        raise DuplicateKeys(", ".join(key))
    return out


def write_delimited(df: DataFrame, path: str, sep: str = ";", encoding: str = "utf-8") -> None:
    _allow(df.sparkSession, encoding)
    df.write.csv(path, sep=sep, header=True, encoding=encoding, lineSep="\n")


def read_store(spark: SparkSession, path: str, schema: T.StructType, key: str, order: list[str]) -> DataFrame:
    """JSON lines with the last write of each key; lines that don't parse are left out."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).cache().where("_bad IS NULL").drop("_bad")
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order), F.to_json(F.struct(*schema.names)).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def daily_series(files: DataFrame, first: str, last: str, values: list[str], key: str = "zone") -> DataFrame:
    """Rows (key, day, values) from rows that hold parallel arrays `time` and values; files that don't cover first to last
    without a gap are left out."""
    due = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1
    ok = (F.size("time") == due) & (F.element_at("time", 1) == first) & (F.element_at("time", -1) == last)
    rows = files.where(ok).select(key, F.explode(F.arrays_zip("time", *values)).alias("r"))
    return rows.select(key, F.col("r.time").cast("date").alias("day"), *(F.col(f"r.{v}").alias(v) for v in values))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, sha256): a fingerprint of each table's rows that doesn't depend on their order."""
    out = None
    for name, df in tables.items():
        one = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        part = df.select(F.conv(F.substring(one, 1, 15), 16, 10).cast("decimal(38,0)").alias("h"), one.alias("s")).agg(F.count(F.lit(1)).alias("rows"), F.sum("h").alias("total"), F.min("s").alias("low"), F.max("s").alias("high"))
        part = part.select(F.lit(name).alias("name"), "rows", F.sha2(F.concat_ws("|", "rows", "total", "low", "high"), 256).alias("sha256"))
        out = part if out is None else out.unionByName(part)
    return out


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, header) of headed CSV files: UTF-8 if all lines are, else Windows-1252. Lines are read wherever the
    files' blocks are, as bytes; a header is the first line of its file's first block."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    head = F.min_by(F.when(F.col("at") == 0, F.col("value").cast("binary")), F.when(F.col("at") == 0, F.col("n")))
    return lines.groupBy("file").agg(F.when(F.bool_and(F.is_valid_utf8("value")), "utf-8").otherwise("windows-1252").alias("encoding"), head.alias("header"))


def read_sniffed(spark: SparkSession, path: str, quoted_lines: bool = True) -> DataFrame:
    """(file, place, cells, odd) of headed CSV files whose encoding and separator are told from each file: UTF-8 with or
    without a BOM, else Windows-1252; of semicolon, comma and tab the one that the header has most of.

    cells maps the header's names to the row's values, place rises along a file, and odd is the raw row where its cells
    aren't as many as the header's. Files alike are read together by Spark's own reader. quoted_lines: values may span
    lines, which makes a file one task, though never held whole; else a large file is split. Empty files have no rows.
    """
    kinds: dict[tuple[str, str, tuple[str, ...]], list[str]] = {}
    for r in sniffed(spark, path).toLocalIterator():  # a row a file
        head = bytes(r.header or b"").decode("utf-8-sig" if r.encoding == "utf-8" else "cp1252", errors="replace")
        sep = max(";,\t", key=lambda s: (head.count(s), s == ";"))
        names = next(csv.reader([head], delimiter=sep), [])
        if names:
            kinds.setdefault((r.encoding, sep, tuple(names)), []).append(unquote(r.file))
    out = spark.createDataFrame([], "file string, place long, cells map<string,string>, odd string")
    for (encoding, sep, names), paths in kinds.items():
        _allow(spark, encoding)
        inner = T.StructType([*(T.StructField(f"c{i}", T.StringType()) for i in range(len(names))), T.StructField("odd", T.StringType())])
        raw = spark.read.schema(inner).csv(paths, sep=sep, encoding=encoding, header=True, enforceSchema=True, multiLine=quoted_lines, quote='"', escape='"', emptyValue="", columnNameOfCorruptRecord="odd")
        pairs = {n: f"c{i}" for i, n in enumerate(names)}  # of a repeated name the last
        cells = F.create_map(*(x for n, col in pairs.items() for x in (F.lit(n), F.col(col))))
        out = out.unionByName(raw.select(F.regexp_extract("_metadata.file_path", "([^/]+)$", 1).alias("file"), F.monotonically_increasing_id().alias("place"), cells.alias("cells"), "odd"))
    return out


#: Nested layout of open place data.
PLACE = "id string, names struct<primary:string,common:map<string,string>>, kind string, confidence double, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, sources array<struct<dataset:string,license:string,record:string>>"


def read_places(spark: SparkSession, path: str, kinds: list[str], least: float = 0.7, licence: str = "CDLA") -> DataFrame:
    """(id, name, kind, lat, lon, confidence) of places of the given kinds that are sure enough and all of whose sources
    have the licence; no sources, or none known, is not enough. Of the nested columns only the used leaves are read."""
    rows = spark.read.schema(PLACE).parquet(path)
    free = F.forall(F.col("sources.license"), lambda x: F.coalesce(x.startswith(licence), F.lit(False)))
    rows = rows.where(F.col("kind").isin(*kinds) & (F.col("confidence") >= least) & (F.size("sources") > 0) & free)
    return rows.select("id", F.col("names.primary").alias("name"), "kind", F.col("bbox.ymin").alias("lat"), F.col("bbox.xmin").alias("lon"), "confidence")


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, layer, row, col, value) of the arrays in npz files: a row per finite cell; two-dimensional arrays have
    layer 0. A file is read by one task and leaves it in pieces of 65,536 cells."""

    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content")
    return raster_cells(raw)


def raster_cells(raw: DataFrame) -> DataFrame:
    """Cells as read_rasters() gives them, of rows (file, content)."""

    def cells(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    for name in z.files:
                        a = z[name]
                        if a.ndim not in (2, 3):
                            continue
                        a = a.reshape((-1, *a.shape[-2:]))
                        at = np.flatnonzero(np.isfinite(a.ravel().astype(float)))
                        for i in range(0, len(at), 65536):
                            k = at[i : i + 65536]
                            layer, row, col = np.unravel_index(k, a.shape)
                            n = len(k)
                            yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([name] * n), *(pa.array(x.astype(np.int32)) for x in (layer, row, col)), pa.array(a.ravel()[k].astype(float))], names=["file", "name", "layer", "row", "col", "value"])

    return raw.mapInArrow(cells, "file string, name string, layer int, row int, col int, value double")


_TAGS = "tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lat, lon, tags) and ways (id, nodes, tags) of map data in XML, tags as maps."""
    read = lambda row, schema: spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    tags = F.map_from_entries(F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>"))).alias("tags")
    nodes = read("node", f"_id LONG, _lat DOUBLE, _lon DOUBLE, {_TAGS}").select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags)
    ways = read("way", f"_id LONG, nd ARRAY<STRUCT<_ref: LONG>>, {_TAGS}").select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("nodes"), tags)
    return nodes, ways


def html_record(html: Column) -> Column:
    """A page as a record: title, headings, links, paragraphs and the cells of its tables in order, as plain text."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    every = lambda p: F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(p), F.lit(1))
    inside = lambda tag: F.transform(every(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), plain)
    return F.struct(
        F.get(inside("title"), F.lit(0)).alias("title"),
        inside("h[1-3]").alias("headings"),
        every(r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"'>]*)").alias("links"),
        inside("p").alias("paragraphs"),
        inside("t[dh]").alias("cells"),
    )
