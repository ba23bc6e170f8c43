"""Row keys, job widths and the memory of Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(*columns: str) -> list[Column]:
    """128 bits that name a row by its content, as columns k1 and k2: rows that are equal in these columns are interchangeable."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(7), *reversed(columns)).alias("k2")]


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on after its task, and several share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that gives its memory back when its task ends."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def tidy(run: Callable[[pd.DataFrame], pd.DataFrame], column: str, every: int = 16_000_000) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """An applyInPandas function that gives memory back each time it has seen so many bytes of a column of binaries."""
    seen = 0

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        nonlocal seen
        out = run(rows)
        seen += sum(map(len, rows[column]))
        if seen >= every:
            seen = 0
            del rows
            give_back()
        return out

    return group
