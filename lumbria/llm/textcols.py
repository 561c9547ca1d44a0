"""Text columns as flat byte buffers: the common ground of the Arrow operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Null ids take part as the largest id and come out as null again.
NULL_ID = 2**63 - 1

#: bytes.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOWER = np.frombuffer(ASCII_LOWER, np.uint8)


def pick(df: DataFrame, id_col: str, text_col: str, as_id: str = "doc_id", as_text: str = "text") -> DataFrame:
    """Only id and text, under fixed names: whatever other columns df has can't clash."""
    return df.select(id_in(df[id_col]).alias(as_id), F.coalesce(df[text_col], F.lit("")).alias(as_text))


def id_in(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NULL_ID))


def id_out(c: Column) -> Column:
    return F.nullif(c, F.lit(NULL_ID))


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and len + 1 offsets; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte; bytes of longer code points are never in that range."""
    return _LOWER[data]


def blocks(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs i..j of texts with at most so many bytes together, or one longer text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Bounds of every Arrow batch of this subpackage, by rows and by bytes.
BATCH_ROWS, BATCH_BYTES = 4096, 1 << 20


def small_batches(df: DataFrame) -> None:
    """Arrow batches of bounded bytes: long texts must not pile up in a Python worker. All operators ask for the same
    bounds, so that a result that is run later has them whichever was built last."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """What a task has freed goes back to the system: Python workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f with give_back() at the end of each task."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run
