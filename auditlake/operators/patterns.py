"""Pattern counts and the most frequent patterns.

Counting combines on the map side by pattern, so a pattern that makes up a third of all statements
costs one row per task. Top-k filters on a row number, which Spark turns into a group limit before
the shuffle: a pattern type with very many patterns ships k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import classify, normalize
from auditlake.functions import fixed_values as fx
from auditlake.operators.parse import records
from auditlake.profiles import PYTHON, Profile
from auditlake.session import materialize

# Measured size up to which the index of the first-N limit is sent to all tasks.
BROADCAST_BYTES = 64 << 20
# Places after and before every row of a block.
WHOLE_BLOCK, NO_ROW = (1 << 63) - 1, -(1 << 63)
# Place of a file that is not in the file list.
UNLISTED = 999_999_999


def pattern_column(profile: Profile = PYTHON) -> Column:
    """Fingerprint of the counted statements, null for other rows."""
    is_record = F.col("reject_reason").isNull()
    return F.when(is_record, normalize.normalize(F.col("stmt"), profile.name))


def pattern_keys(profile: Profile = PYTHON) -> tuple[str, ...]:
    """Columns that identify a pattern: profile A keeps operation types apart."""
    return ("op_type", "pattern") if profile.name == "A" else ("pattern",)


def counted_patterns(profile: Profile = PYTHON) -> Column:
    """Number of fingerprints; profile A does not count empty ones.

    Expressed as a condition inside the count, not as a filter, because a filter on the fingerprint
    would be pushed below the aggregate and compute every fingerprint twice.
    """
    pattern = F.col("pattern")
    return F.count(F.when(pattern != "", 1)) if profile.name == "A" else F.count(pattern)


def pattern_counts(
    parsed: DataFrame,
    profile: Profile = PYTHON,
    by: Sequence[str] = (),
    pos: str | None = None,
) -> DataFrame:
    """``(*by, pattern, n[, first_pos])``; profile A also groups by ``op_type``.

    ``pos`` names a fixed-width column with the place of the line in its file. Its minimum is kept
    as ``first_pos`` and orders patterns of equal count by first occurrence. A fixed-width type
    (BIGINT or DECIMAL) lets Spark aggregate by hash.
    """
    first = [F.min(pos).alias("first_pos")] if pos else []
    return (
        parsed.withColumn("pattern", pattern_column(profile))
        .groupBy(*by, *pattern_keys(profile))
        .agg(counted_patterns(profile).alias("n"), *first)
        .where(F.col("n") > 0)
    )


def merged_position(file_index: str, pos: str) -> Column:
    """One number that orders by the place of the file in the list, unlisted files last, and then by place."""
    place = F.coalesce(file_index, F.lit(UNLISTED)).cast("decimal(10,0)")
    shifted = place * F.lit("1" + 28 * "0").cast("decimal(29,0)")
    return (shifted + F.col(pos).cast("decimal(28,0)")).cast("decimal(38,0)")


def merge_pattern_counts(per_file: DataFrame, files: DataFrame) -> DataFrame:
    """Per-file pattern counts added up over files: ``(pattern, n, first_pos)``.

    ``files`` gives every ``file`` its ``file_index``. ``first_pos`` orders by file and then by place
    in the file. The join is on already aggregated rows; Spark decides by size whether to broadcast.
    Patterns of a file that is not listed count too, and come after those of all listed files.
    """
    return (
        per_file.join(files.select("file", "file_index"), "file", "left")
        .groupBy("pattern")
        .agg(F.sum("n").alias("n"), F.min(merged_position("file_index", "first_pos")).alias("first_pos"))
    )


def top_patterns(
    counts: DataFrame,
    k: int = fx.TOP_PATTERNS_PER_TYPE,
    min_count: int = fx.MIN_PATTERN_COUNT,
    merged: bool = False,
) -> DataFrame:
    """``(pattern_type, rank, pattern, n)``: the k most frequent patterns of every pattern type.

    Ties keep the order of first occurrence if ``first_pos`` is there. ``merged`` selects the
    shorter type list of the multi-file report.
    """
    tie = ["first_pos", "pattern"] if "first_pos" in counts.columns else ["pattern"]
    window = Window.partitionBy("pattern_type").orderBy(F.desc("n"), *tie)
    return (
        counts.where(F.col("n") >= min_count)
        .withColumn("pattern_type", classify.pattern_type("pattern", merged))
        .withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= k)
        .select("pattern_type", "rank", "pattern", "n")
    )


def top_patterns_by_op_type(
    counts: DataFrame, limits: dict[str, int] | None = None
) -> DataFrame:
    """``(op_type, rank, pattern, n)`` for the types in ``limits``, each with its own k.

    Equal counts are ordered by pattern, descending; there is no minimum count.
    """
    limits = limits or fx.TOP_PATTERNS_BY_OP_TYPE
    window = Window.partitionBy("op_type").orderBy(F.desc("n"), F.desc("pattern"))
    allowed = F.lit(0)
    for op_type, k in limits.items():
        allowed = F.when(F.col("op_type") == op_type, k).otherwise(allowed)
    return (
        counts.withColumn("rank", F.row_number().over(window))
        # The common bound comes first: it is what Spark can apply before the shuffle.
        .where(F.col("rank") <= max(limits.values()))
        .where(F.col("rank") <= allowed)
        .select("op_type", "rank", "pattern", "n")
    )


def first_index(
    rows: DataFrame, limit: int, block: Sequence[str], order: str, file: str = "file"
) -> DataFrame:
    """``(file, *block, last)``: up to which ``order`` the rows of each block are among the first ``limit``.

    ``rows`` are scanned once, into one bit per row: 64 neighbouring places are one mask, so the index is a
    small fraction of the log. Counts of blocks and their running sum per file give the one block of every
    file in which the limit falls; only there the masks are walked, and the last place is a bit number. No
    row is ranked, and none is shuffled: masks combine on the map side.
    """
    keys = [file, *block]
    place = F.col(order).cast("bigint")
    masks = materialize(
        rows.groupBy(*keys, F.shiftright(place, 6).alias("word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, CAST(CAST({order} AS BIGINT) & 63 AS INT)))").alias("bits"))
        .withColumn("word_rows", F.bit_count("bits").cast("bigint"))
    )
    in_file = Window.partitionBy(file).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        masks.groupBy(*keys)
        .agg(F.sum("word_rows").alias("block_rows"))
        .withColumn("before", F.coalesce(F.sum("block_rows").over(in_file), F.lit(0)))
    )
    blocks = materialize(blocks)
    wanted = F.lit(limit) - F.col("before")
    boundary = blocks.where((F.col("before") < limit) & (F.col("before") + F.col("block_rows") > limit))
    in_block = Window.partitionBy(*keys).orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    set_bits = F.filter(
        F.sequence(F.lit(0), F.lit(63)), lambda n: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), n)) != 0
    )
    cut = (
        masks.join(boundary.select(*keys, wanted.alias("wanted")), keys)
        .withColumn("seen", F.coalesce(F.sum("word_rows").over(in_block), F.lit(0)))
        .where((F.col("seen") < F.col("wanted")) & (F.col("wanted") <= F.col("seen") + F.col("word_rows")))
        .withColumn("bit", F.element_at(set_bits, (F.col("wanted") - F.col("seen")).cast("int")))
        .select(*keys, (F.shiftleft("word", 6) + F.col("bit")).alias("cut"))
    )
    last = F.when(wanted >= F.col("block_rows"), F.lit(WHOLE_BLOCK)).when(wanted <= 0, F.lit(NO_ROW)).otherwise(F.col("cut"))
    return materialize(blocks.join(cut, keys, "left").select(*keys, last.alias("last")))


def first_records(
    parsed: DataFrame,
    limit: int | None,
    block: Sequence[str],
    order: str,
    file: str = "file",
    profile: Profile = PYTHON,
) -> DataFrame:
    """The first ``limit`` counted rows of every file, in file order; all of them for 0 or None.

    ``block`` names columns that cut a file into ordered blocks (for text files the start of the file
    split), and ``order`` the place within a block, a whole number that no two rows of a block share.
    Profile A counts only rows with a fingerprint. Rows pass by comparing their place with the last one
    that ``first_index`` gives for their block: whole blocks and the boundary block alike go through
    without a sort or an exchange of log rows.

    The index has a row per block. It is sent to all tasks where its measured size allows that, else Spark
    joins it as it sees fit. The blocks of the first pass must be those of the second: a row whose block is
    unknown means that the file splits changed in between, and fails the job instead of giving a wrong
    answer. Fixing ``spark.sql.files.minPartitionNum`` keeps the splits stable when the number of
    cores varies.
    """
    rows = records(parsed)
    if not limit or limit <= 0:
        return rows
    if profile.name == "A":
        rows = rows.where(normalize.normalize(F.col("stmt"), profile.name) != "")
    keys = [file, *block]
    index = first_index(rows, limit, block, order, file)
    size = index.agg(
        F.coalesce(F.sum(sum((F.octet_length(F.col(k).cast("string")) for k in keys), F.lit(16 * (len(keys) + 1)))), F.lit(0))
    ).first()[0]
    if size <= BROADCAST_BYTES:
        index = F.broadcast(index)
    last = F.coalesce(F.col("last"), F.raise_error(F.lit("file splits changed between passes")).cast("bigint"))
    return rows.join(index, keys, "left").where(F.col(order) <= last).drop("last")
