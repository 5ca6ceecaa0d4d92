"""The two base aggregates of all reports, computed in one pass over the logs.

A report needs counts per (category, second) and counts per pattern. As two queries they would read
and parse the logs twice, which is nearly all of the work. ``base_aggregates`` groups by two grouping
sets instead: every row is scanned and parsed once and enters both aggregates. The result is small
against the logs (it grows with seconds and distinct patterns, not with lines) and is written once
as a table with one partition per aggregate; all report parts read that instead of the logs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import classify
from auditlake.operators import aggregate, patterns
from auditlake.operators.parse import IGNORED, IGNORED_AFTER_CUT, unparsed_line
from auditlake.profiles import PYTHON, Profile
from auditlake.session import materialize


# Parts of the stored table of several files.
PATTERNS, CELLS, FILES = 0, 1, 2


@dataclass(frozen=True)
class BaseAggregates:
    """``ops`` per second, ``patterns`` with their counts, and the line counts of the run."""

    profile: Profile
    ops: DataFrame
    patterns: DataFrame
    line_counts: DataFrame


def base_aggregates(
    parsed: DataFrame,
    profile: Profile = PYTHON,
    by: Sequence[str] = (),
    pos: str | None = None,
) -> BaseAggregates:
    """Both aggregates from one scan of ``parsed``; ``by`` keeps files apart."""
    cell_keys = [*by, "reject_reason", "op_category", "second_key"]
    pattern_keys = [*by, *patterns.pattern_keys(profile)]
    columns = list(dict.fromkeys([*cell_keys, *pattern_keys]))
    # Rows without a pattern share one null group per task and are dropped below.
    rows = parsed.withColumn("pattern", patterns.pattern_column(profile))
    first = [F.min(pos).alias("first_pos")] if pos else []
    both = rows.groupingSets([cell_keys, pattern_keys], *columns).agg(
        F.grouping("pattern").cast("int").alias("is_cell"),
        F.count(F.lit(1)).alias("rows"),
        F.count("op_category").alias("n"),
        patterns.counted_patterns(profile).alias("patterns_n"),
        *first,
    )
    both = materialize(both, partition_by=["is_cell"])

    cells = both.where((F.col("is_cell") == 1) & (F.col("n") > 0))
    counted = both.where((F.col("is_cell") == 0) & (F.col("patterns_n") > 0))
    return BaseAggregates(
        profile,
        aggregate.finish_cells(cells, profile, by),
        counted.select(*pattern_keys, F.col("patterns_n").alias("n"), *(["first_pos"] if pos else [])),
        _line_counts(both, F.col("is_cell") == 1, profile),
    )


def _line_counts(stored: DataFrame, is_cell: Column, profile: Profile) -> DataFrame:
    """Line counts of the run, added up from the stored cells."""
    reason = F.col("reject_reason")
    ignored = reason.isin(IGNORED, IGNORED_AFTER_CUT)

    def lines_where(condition) -> Column:
        return F.coalesce(F.sum(F.when(is_cell & condition, F.col("rows"))), F.lit(0))

    return stored.agg(
        lines_where(F.lit(True)).alias("lines"),
        lines_where(reason.isNull() | (reason == IGNORED_AFTER_CUT)).alias("parsed"),
        lines_where(reason.isNull()).alias("operations"),
        lines_where(reason.isNotNull() & ignored).alias("ignored"),
        lines_where(reason.isNotNull() & ~ignored).alias("rejected"),
        lines_where(unparsed_line(profile)).alias("unparsed"),
    )


@dataclass(frozen=True)
class MergedAggregates(BaseAggregates):
    """Counts of all files together, and ``per_file`` with the operations of every file."""

    per_file: DataFrame


def measured_bytes(table: DataFrame, *columns: str) -> int:
    """Bytes that the values of ``columns`` take, with eight more per value."""
    each = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in columns), F.lit(0))
    return table.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


def merged_aggregates(
    parsed: DataFrame, files: DataFrame, pos: str, profile: Profile = PYTHON
) -> MergedAggregates:
    """The aggregates of a report over several files, from one scan of ``parsed``.

    Three grouping sets leave the scan: (file, category), (category, second) and (pattern). Neither
    seconds nor patterns are kept per file, so what is shuffled does not grow with the number of files
    that share them. The place of a file in the list leads the position of a line, which then orders
    patterns by file and place in the file as a single minimum. For that, every line needs its file's
    place; the file list must be of a size that all tasks can hold (``patterns.BROADCAST_BYTES``).
    """
    places = files.select("file", "file_index")
    cell_keys = ["reject_reason", "op_category", "second_key"]
    pattern_keys = [*patterns.pattern_keys(profile)]
    file_keys = ["file", "op_category"]
    columns = list(dict.fromkeys([*cell_keys, *pattern_keys, *file_keys]))
    rows = (
        parsed.withColumn("pattern", patterns.pattern_column(profile))
        .join(F.broadcast(places), "file", "left")
        .withColumn("merged_pos", patterns.merged_position("file_index", pos))
    )
    part = F.when(F.grouping("pattern") == 0, PATTERNS).when(F.grouping("file") == 0, FILES).otherwise(CELLS)
    both = rows.groupingSets([cell_keys, pattern_keys, file_keys], *columns).agg(
        part.alias("part"),
        F.count(F.lit(1)).alias("rows"),
        F.count("op_category").alias("n"),
        patterns.counted_patterns(profile).alias("patterns_n"),
        F.min("merged_pos").alias("first_pos"),
    )
    both = materialize(both, partition_by=["part"])
    cells = both.where((F.col("part") == CELLS) & (F.col("n") > 0))
    counted = both.where((F.col("part") == PATTERNS) & (F.col("patterns_n") > 0))
    per_file = both.where((F.col("part") == FILES) & (F.col("n") > 0))
    return MergedAggregates(
        profile,
        aggregate.finish_cells(cells, profile),
        counted.select(*pattern_keys, F.col("patterns_n").alias("n"), "first_pos"),
        _line_counts(both, F.col("part") == CELLS, profile),
        per_file.select("file", classify.op_type_of("op_category").alias("op_type"), "n"),
    )
