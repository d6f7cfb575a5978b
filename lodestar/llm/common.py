"""What the operators of this package share: bounded Arrow batches, raw byte views and digests."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch at most: a batch of very long texts must fit a worker's memory.
BATCH_ROWS = 512

#: Bytes of text that a vectorised kernel handles at once.
CHUNK_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release_memory() -> None:
    """Give what a task has freed back to the system; workers stay for later tasks, and their memory adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with bounded batches; a worker returns its free memory after each task."""
    bounded_batches(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows (int64, one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about limit bytes each; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(stop, n)
        start = stop


def source_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Just the named columns under their short names, so that clashing extra columns do no harm."""
    return df.select(*(F.col(f"`{name}`").alias(short) for short, name in wanted.items()))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken yet: name with underscores before it."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """The documents that no model learns from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
