"""Bounded samples of labelled rows, and folds by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import text_or_empty


def fold(id: str, folds: int) -> Column:
    """crc32 of the identifier's decimal text, modulo ``folds``; 0 folds for no identifier."""
    return F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    learnable: Column,
    per_class: int,
    text: str = "text",
    id: str = "doc_id",
) -> DataFrame:
    """``(id, text, label)`` of at most ``per_class`` documents of either class, by hash order.

    Identifiers without a label, or labelled both ways, are left out. The chosen identifiers are at
    most ``2 * per_class`` rows, which is the bound of the broadcast that finds their texts. An identifier
    gives one row however many rows repeat it; of several texts it is the least.
    """
    once = (
        labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1) & learnable)
        .groupBy(id)
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where(F.col("label") == F.col("other"))
        .select(F.col(id).alias("id"), F.col("label").cast("int").alias("label"))
    )
    chosen = None
    for value in (0, 1):
        part = once.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col(id).alias("id"), text_or_empty(text).alias("text"))
    found = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return found.select("id", "text", "label")
