"""Helpers shared by the operators: bounded broadcasts and sorted streams of Arrow rows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.sources.shipping import ship

#: Rows of at most a few numbers each that a join may broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000


def give_back() -> None:
    """Return unused memory of this process to the system; a worker lives on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with this package on the executors."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The written table df as a side of a join: broadcast if it has few rows, else left to Spark.

    The rows are counted up to the limit. Only tables of ids and numbers may be given.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_rows(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, str]]:
    """Row number and text of each row, an empty text for a null, one at a time."""
    values = batch.column(batch.schema.get_field_index(column))
    for i in range(len(values)):
        yield i, values[i].as_py() or ""


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Each value of key with its rows, from batches in which equal keys follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        begin = 0
        for i, k in enumerate(keys):
            if held and begin == i and k != last:
                yield last, pa.Table.from_batches(held)
                held = []
            if i > begin and k != last:
                held.append(batch.slice(begin, i - begin))
                yield last, pa.Table.from_batches(held)
                held, begin = [], i
            last = k
        held.append(batch.slice(begin))
    if held:
        yield last, pa.Table.from_batches(held)
