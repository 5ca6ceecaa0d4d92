"""Sharding by a permutation of global row numbers.

Rows get the numbers 0 to N - 1 in the order of their identifiers. A Feistel network permutes the smallest
square power of two that holds them: the number is cut into two halves, and each round adds a keyed mix of
one half to the other. Numbers that land at N or above are sent through the network again until they come
back below N (cycle walking), which makes it a permutation of exactly the N row numbers. The place ``p`` of a
row gives its shard ``p % shards`` and its slot ``p // shards``, so shards differ by one row at most.

Nothing is stored: shard and slot of any row number can be computed, and the network runs backwards, so
the row behind any shard and slot can be computed too. The same table, seed and number of shards always
give the same shards.

Scale: the only exchanges are the range sort that numbers the rows (keys only where no text is written) and,
for files, one by file. Equal rows are spread by their place in the input, so a hot key cannot fill a range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import materialize, text_or_empty

SHARDS, SEED, ROUNDS = 16, 20_240_611, 6
FILE_ROWS = 100_000
ROW_BITS = 33
# Odd multipliers of the round function, modulo 2**32.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77)
WORD = 2**32


def _mix(half: np.ndarray, key: int) -> np.ndarray:
    """The round function: 32 mixed bits of a number below 2**32."""
    x = ((half ^ np.uint64(key)) * np.uint64(MULTIPLIERS[0])) % np.uint64(WORD)
    x ^= x >> np.uint64(15)
    x = (x * np.uint64(MULTIPLIERS[1])) % np.uint64(WORD)
    return x ^ (x >> np.uint64(13))


class Permutation:
    """A keyed permutation of the numbers 0 to ``total`` - 1 (at most 2**62 of them)."""

    def __init__(self, total: int, seed: int = SEED, rounds: int = ROUNDS):
        self.total = total
        self.half_bits = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
        self.keys = [int(_mix(np.uint64([seed % WORD]), 0x1000 + n)[0]) for n in range(rounds)]

    def _network(self, numbers: np.ndarray, back: bool = False) -> np.ndarray:
        bits, mask = np.uint64(self.half_bits), np.uint64((1 << self.half_bits) - 1)
        left, right = numbers >> bits, numbers & mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (_mix(left, key) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key) & mask)
        return (left << bits) | right

    def _walk(self, numbers, back: bool) -> np.ndarray:
        found = self._network(np.asarray(numbers).astype(np.uint64), back)
        outside = np.flatnonzero(found >= self.total)
        while len(outside):
            found[outside] = self._network(found[outside], back)
            outside = outside[found[outside] >= self.total]
        return found.astype(np.int64)

    def places(self, numbers) -> np.ndarray:
        """Where the rows of these numbers go."""
        return self._walk(numbers, back=False)

    def numbers(self, places) -> np.ndarray:
        """Which rows are at these places."""
        return self._walk(places, back=True)


def number_rows(rows: DataFrame, *order: str | Column) -> tuple[DataFrame, int]:
    """``rows`` with a ``row_number`` from 0 in the given order, and how many there are.

    Sorted ranges are counted, and a running sum over that table, which has one row per range, gives each
    range its first number. Rows that are equal in ``order`` are numbered in any order among themselves.
    """
    placed = (
        rows.select("*", F.monotonically_increasing_id().alias("_input"))
        .repartitionByRange(*order, "_input")
        .sortWithinPartitions(*order, "_input")
        .drop("_input")
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_in_range", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    )
    placed = materialize(placed)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    firsts = ranges.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    # One row of 12 bytes per range; there are as many as shuffle partitions.
    numbered = placed.join(F.broadcast(firsts), "_range").withColumn("row_number", F.col("_first") + F.col("_in_range"))
    return numbered.drop("_range", "_in_range", "_first"), placed.count()


def _placed(numbered: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    permutation = Permutation(total, seed)

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permutation.places(numbers.to_numpy()))

    return (
        numbered.withColumn("place", place("row_number"))
        .withColumn("shard", (F.col("place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"place div {shards}"))
        .drop("place")
    )


def _keys(text: str, id: str) -> list[Column]:
    value = text_or_empty(text)
    return [
        F.col(id).alias("id"),
        F.octet_length(value).cast("long").alias("bytes"),
        F.crc32(value).alias("crc"),
        F.xxhash64(value).alias("check"),
    ]


def assign(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """``(id, bytes, crc, row_number, shard, slot)`` of every row; the counts of shards differ by one at most.

    Rows are numbered by identifier, null first, then by text; so repeated identifiers keep their own
    slots, and only rows equal in both may swap theirs. A null text counts as empty. Other columns do not
    matter; an empty table gives no rows.
    """
    # Stored first: the range sort reads its input twice, and should not read texts twice.
    keys = materialize(docs.select(*_keys(text, id)))
    numbered, total = number_rows(keys, "id", "crc", "bytes", "check")
    return _placed(numbered, total, shards, seed).drop("check")


def write_shards(
    docs: DataFrame,
    folder: str,
    shards: int = SHARDS,
    seed: int = SEED,
    text: str = "text",
    id: str = "doc_id",
    file_rows: int = FILE_ROWS,
) -> int:
    """Write all rows as Parquet under ``folder/shard=S/file=F``, sorted by slot; returns the number of rows.

    File ``F`` of a shard holds its slots ``F * file_rows`` up to the next file's, so a slot's file can be
    computed. The columns of ``docs`` are the fields of ``document``, whatever their names are.
    """
    whole = docs.select(F.struct("*").alias("document"), *_keys(text, id))
    numbered, total = number_rows(whole, "id", "crc", "bytes", "check")
    (
        _placed(numbered, total, shards, seed)
        .select("document", "row_number", "slot", "shard", F.expr(f"slot div {file_rows}").alias("file"))
        .repartition("shard", "file")
        .sortWithinPartitions("shard", "file", "slot")
        .write.partitionBy("shard", "file")
        .parquet(folder)
    )
    return total


def read_shard(spark: SparkSession, folder: str, shard: int) -> DataFrame:
    """``(document, row_number, slot, file)`` of one shard, from its files only."""
    return spark.read.parquet(folder).where(F.col("shard") == shard).drop("shard")
