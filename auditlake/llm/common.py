"""Small helpers the operators share: tables in, text as bytes, stages in the shared folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import materialize

__all__ = ["batch_bytes", "in_slices", "materialize", "release", "table", "text_or_empty", "texts_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from wherever ``sf_dir`` is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column, null as the empty string."""
    return [text or "" for text in column.to_pylist()]


def batch_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each text begins (one more for the end)."""
    parts = [text.encode("utf-8", "surrogatepass") for text in texts]
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), ends


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut into smaller ones, so that a task holds few texts and results at a time.

    At the end of a task's input, memory that is free but held by the worker goes back to the machine: the
    worker lives on, and other stages need it.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Return what the allocators of this worker hold without using it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        return


def release(spark: SparkSession) -> None:
    """Free what finished steps left on the driver, and the shuffle files they left on executors.

    Plans, broadcast blocks and shuffles of tables that are written go when the driver collects its
    garbage. With many small steps in a row its heap reaches its limit before that; called between steps
    it stays near what is still used.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()
