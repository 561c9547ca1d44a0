"""WARC archives: an index first, then coalesced byte-range reads of the records that it selects."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialised, scratch
from .textcols import id_in, id_out, small_batches, trimmed

#: Ranges with at most so many bytes between them are one read, of at most so many bytes.
GAP, READ = 64 << 10, 4 << 20
#: A reading task has the records that begin within so many bytes of an archive.
SLICE = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, url string, digest string, file string, offset long, length long"
_RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _name(page_id: int) -> str:
    return f"<urn:lumbria:page:{page_id}>"


def _number(name: str) -> int:
    return int(name[: -1].rpartition(":")[2])


def record(page_id: int, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit of refers_to without. Bytes that a header can't hold are
    percent-encoded in the url; a null url has no header."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        body += payload or b""
    else:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers and HTTP body."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    return h | {"body": block.partition(b"\r\n\r\n")[2]}


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = FileSystem.from_uri(folder)
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for b in batches:
                rows = []
                for page_id, url, html, sha, size, refers in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                    if out is None:
                        fs.create_dir(top, recursive=True)
                        out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    raw = record(page_id, url, html.encode() if html is not None else None, digest, size, refers)
                    raw = z.compress(raw) + z.flush()
                    out.write(raw)
                    rows.append((page_id, url, digest, name, at, len(raw)))
                    at += len(raw)
                cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "digest", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record per row into archives in folder (one a task, a gzip member a record) and returns their index:
    page_id, url, digest, file, offset, length.

    Payloads are the column's UTF-8 bytes, null: none. Of equal payloads of at least `least` bytes, that of the smallest
    id is a response (each of its rows, if an id repeats) and the others are revisits of it; smaller ones are all
    responses. Digests are counted without the payloads; the payloads are dealt by id, so copies of one page, however
    many, are spread evenly, and a revisit's payload goes to no task of Python. A task that is run again writes a new
    file, and only files that the index names count. A null id counts as the largest.
    """
    small_batches(pages)
    p = pages.select(id_in(pages[id_col]).alias("page_id"), pages[url_col].alias("url"), pages[payload_col].alias("html"))
    p = p.withColumn("size", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")).withColumn("sha", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    light = materialised(p.select("page_id", "sha", "size").distinct(), "digests")
    first = light.where(F.col("size") >= least).groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = light.join(first, "sha").where("page_id <> refers_to").select("page_id", "sha", "refers_to")
    rows = p.join(later.hint("shuffle_hash"), ["page_id", "sha"], "left")
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "sha", "size", "refers_to")
    return materialised(rows.mapInArrow(trimmed(_written(folder)), _INDEX), "cdx")


def ranges(places: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) places as (begin, end, places) reads."""
    own: list[tuple[int, int]] = []
    for off, n in places:
        if own and (off > own[-1][0] + own[-1][1] + gap or off + n > own[0][0] + most):
            yield own[0][0], own[-1][0] + own[-1][1], own
            own = []
        own.append((off, n))
    if own:
        yield own[0][0], own[-1][0] + own[-1][1], own


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = FileSystem.from_uri(folder)
        for b in batches:
            by: dict[str, list[tuple[int, int]]] = {}
            for f, o, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                by.setdefault(f, []).append((o, n))
            for f, places in by.items():
                with fs.open_input_file(f"{top}/{f}") as src:
                    for begin, end, own in ranges(places):
                        data, rows = src.read_at(end - begin, begin), []
                        for o, n in own:
                            h = parse(zlib.decompress(data[o - begin : o - begin + n], 31))
                            digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                            response = h["WARC-Type"] == "response"
                            if response and base64.b32encode(hashlib.sha1(h["body"]).digest()).decode() != digest:
                                raise ValueError(f"{f}, {o}: the payload doesn't have its digest")
                            rows.append((_number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["body"] if response and payloads else None, len(h["body"]) if response else int(h["X-Payload-Length"]), digest, h["WARC-Type"], None if response else _number(h["WARC-Refers-To"])))
                        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index rows in selected. Rows are dealt by file and slice, sorted by offset, and near ranges
    are read at once; each record is unpacked alone, and a response's payload is held against its digest. There are as
    many tasks as the records have slices of bytes: the index is small, and its own size says nothing of the reading."""
    at = selected.select("file", "offset", "length", F.floor(F.col("offset") / SLICE).alias("slice"))
    tasks = max(1, -(-(selected.agg(F.sum("length")).first()[0] or 0) // SLICE))
    at = at.repartition(tasks, "file", "slice").sortWithinPartitions("file", "offset")
    out = at.mapInArrow(trimmed(_read(folder, payloads)), _RECORD)
    return out.withColumn("page_id", id_out(F.col("page_id"))).withColumn("refers_to", id_out(F.col("refers_to")))


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder, payloads=False).drop("payload", "url").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 by arithmetic: five hexadecimal digits are four of base 32.
SQL_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), '') AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""
