"""Exact dedup as a tree merge of sorted digest runs.

Every partition of the input makes one run of ``(digest, keeper, rows)``: its texts are hashed, the
run is sorted by digest, and equal digests collapse, so a run holds a text once however often the
partition repeats it. Runs meet in binomial rounds: in round ``r`` the ``fan_in ** r`` runs whose
numbers share their upper bits are exchanged by ``(upper bits, digest)`` and merged in sorted order,
and every merge keeps the extreme identifier of a digest and the number of rows. The last round has
one number left and so merges by digest alone.

Equality is verified at every level, because the merge key is not the digest alone: it also holds the
length and a second, unrelated 64-bit hash of the text. Two texts that agreed in SHA-256 only would
stay apart.

Scale: only 48-byte keys are shuffled, collapsed before each exchange, so a text that makes up a third
of all rows is one row per task from the first round on. No step collects rows of a group. All of it is
DataFrame operations on built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import materialize, text_or_empty

FAN_IN_BITS = 4
KEY = ("digest", "check", "n_bytes")


def digests(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(id, digest, check, n_bytes)`` of every row; a null text counts as the empty text."""
    value = text_or_empty(text)
    return docs.select(
        F.col(id).alias("id"),
        F.unhex(F.sha2(value, 256)).alias("digest"),
        F.xxhash64(value).alias("check"),
        F.octet_length(value).alias("n_bytes"),
    )


def merge_runs(rows: DataFrame, keep: str = "max", fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """``(digest, check, n_bytes, keep_id, group_size)``, one row per distinct text."""
    best, rank = {"max": (F.max, F.col("id").isNotNull()), "min": (F.min, F.col("id").isNull())}[keep]
    # How many runs there are decides how many rounds follow; reads no column of the input.
    last = rows.select(F.spark_partition_id().alias("run")).agg(F.max("run")).first()[0] or 0
    rounds = max(1, -(-int(last).bit_length() // fan_in_bits))
    runs = rows.select(
        *KEY, F.spark_partition_id().alias("run"), F.struct(rank, "id").alias("keeper"), F.lit(1).alias("n")
    )
    for level in range(1, rounds + 1):
        group: list[str | Column] = list(KEY)
        if level < rounds:
            group.insert(0, F.shiftright("run", fan_in_bits).alias("run"))
        # The keeper is a struct, which Spark aggregates by sorting: runs stay sorted by key.
        runs = runs.groupBy(*group).agg(best("keeper").alias("keeper"), F.sum("n").alias("n"))
    return runs.select(*KEY, F.col("keeper.id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(
    docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "max"
) -> DataFrame:
    """One row per row of ``docs``: ``(id, keep_id, group_size, kept, digest)``.

    Texts are equal when identical after no change. Of equal texts the largest (``keep="max"``) or
    smallest identifier stays. Null texts equal empty ones. Rows that repeat the keeper's identifier
    with the same text all count and are all marked kept; a null identifier is never a keeper unless
    the whole group has none. An empty table gives no rows, and other columns do not matter.
    """
    rows = digests(docs, text, id)
    # Texts that occur once need no join partner: only repeated ones travel. They are written as a
    # table, so that the join has an exchange of its own on both sides and Spark can split a hot text.
    repeated = materialize(merge_runs(rows, keep).where(F.col("group_size") > 1))
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return (
        rows.join(repeated, list(KEY), "left")
        .select(
            F.col("id"),
            keep_id.alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.col("digest"),
        )
        .select(
            F.col("id").alias(id),
            "keep_id",
            "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "digest",
        )
    )


def drop_copies(
    docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "max"
) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; rows without an identifier stay.

    A row goes by its identifier and its text together: another text under the same identifier stays.
    """
    dropped = (
        exact_dedup(docs, text, id, keep)
        .where(~F.col("kept"))
        .select(F.col(id).alias("__dropped_id"), F.col("digest").alias("__dropped_digest"))
        .distinct()
    )
    digest = F.unhex(F.sha2(text_or_empty(text), 256))
    here = (docs[id] == F.col("__dropped_id")) & (digest == F.col("__dropped_digest"))
    return docs.join(dropped, here, "left_anti").select(*docs.columns)
