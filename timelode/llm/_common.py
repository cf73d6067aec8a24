"""Shared plumbing: written tables in the cluster's shared folder, and slices of Arrow text columns."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.sources import shared
from timelode.sources.shared import discard  # noqa: F401

#: Bytes of text that are worked on at a time, and bytes of an Arrow batch of texts in the jobs that operators run themselves.
SLICE_BYTES, BATCH_BYTES = 1 << 20, 8 << 20
#: Words of 64 bits in a filter of hashes: 4 MB as (word, bits) rows, however many hashes there are.
FILTER_WORDS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """shared.written() with small Arrow batches."""
    with small_arrow(df.sparkSession):
        return shared.written(df, name, by)


@contextmanager
def small_arrow(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of about so many bytes at most, for the jobs that run inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bucket_of(column: str = "doc_id", n: int = 5):
    """crc32 of the id written in decimal, modulo n: the fold rule of the labelled operators. A null id gives null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def _bit(of: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(of, 58).cast("int"))


def hash_filter(hashes: DataFrame, column: str) -> DataFrame:
    """word and bits of a bit filter of the 64-bit hashes in a column: at most FILTER_WORDS rows.

    Beyond some 10 million hashes most bits are set, and the filter lets most rows pass; it never loses one.
    """
    word = F.col(column).bitwiseAND(F.lit(FILTER_WORDS - 1))
    return hashes.groupBy(word.alias("word")).agg(F.bit_or(_bit(F.col(column))).alias("bits"))


def passing(df: DataFrame, of: Column, bits: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of df whose hash may be in the filter; with how="left_anti" those whose hash is surely not. Neither moves rows of df."""
    word = of.bitwiseAND(F.lit(FILTER_WORDS - 1))
    return df.join(F.broadcast(bits), (word == bits["word"]) & (bits["bits"].bitwiseAND(_bit(of)) != 0), how)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, int64 offsets of the rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of each slice of a text column."""
    data, offsets = text_buffers(column)
    for i, j in row_slices(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function after whose end the worker gives freed memory back: workers are kept, and what one has freed is of no use to the others."""

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return inner


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, without copies."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
