"""The four reports as named DataFrames, and in long form as one table of rows.

* ``single_report`` (profile P): totals, category counts and concurrency of all five operation
  types, top patterns, distribution.
* ``merged_report`` (several files): file overview, merged totals, read and write sections without
  per-category concurrency, patterns by the shorter type list.
* ``awk_report`` (profile A): read, write and schema change sections, patterns by operation type,
  a sample of rejected lines.
* ``shell_report`` (profile E): totals, read and write category counts, distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import fixed_values as fx
from auditlake.operators import aggregate, parse, patterns, rejects
from auditlake.plans.base import base_aggregates, measured_bytes, merged_aggregates
from auditlake.profiles import AWK, PYTHON, SHELL, Profile

MERGED_SECTIONS = ("read", "write")
AWK_SECTIONS = ("read", "write", "schema_change")
SHELL_SECTIONS = ("read", "write")


def _sections(df: DataFrame, op_types: Sequence[str]) -> DataFrame:
    return df.where(F.col("op_type").isin(list(op_types)))


def _limited_patterns(
    parsed: DataFrame, profile: Profile, limit: int | None, block: Sequence[str], order: str,
    by: Sequence[str], pos: str | None,
) -> DataFrame | None:
    if not limit or limit <= 0:
        return None
    first = patterns.first_records(parsed, limit, block, order, profile=profile)
    return patterns.pattern_counts(first, profile, by, pos)


def single_report(
    lines: DataFrame,
    ignore: Sequence[str] = (),
    tz: str = "UTC",
    pos: str | None = None,
    pattern_limit: int | None = None,
    block: Sequence[str] = ("block_start",),
    order: str = "rid",
    files: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Report over one log, from a single pass (a pattern limit costs two more).

    A log that consists of several files needs their list ``files``: positions are places in a file, and
    patterns of equal count are ordered by file first.
    """
    parsed = parse.parse_lines(lines, PYTHON, ignore, tz)
    if files is None:
        base = base_aggregates(parsed, PYTHON, pos=pos)
    else:
        base = merged_aggregates(parsed, files, pos or "pos")
    limited = _limited_patterns(parsed, PYTHON, pattern_limit, block, order, (), pos)
    counts = base.patterns if limited is None else limited
    return {
        "totals": aggregate.totals(base.ops),
        "category_counts": aggregate.category_counts(base.ops),
        "concurrency_overall": aggregate.concurrency_overall(base.ops),
        "concurrency_by_category": aggregate.concurrency_by_category(base.ops),
        "top_patterns": patterns.top_patterns(counts),
        "time_distribution": aggregate.time_distribution(base.ops),
        "run_metrics": base.line_counts,
        "pattern_counts": counts,
        "ops_per_second": base.ops,
    }


def merged_report(
    lines: DataFrame,
    files: DataFrame,
    ignore: Sequence[str] = (),
    tz: str = "UTC",
    pos: str = "pos",
    pattern_limit: int | None = None,
    block: Sequence[str] = ("block_start",),
    order: str = "rid",
) -> dict[str, DataFrame]:
    """Report over several files: analysed per file and added up, in one pass over all of them.

    ``files`` is the ``(file, file_index)`` list; a pattern limit applies to every file on its own.
    """
    parsed = parse.parse_lines(lines, PYTHON, ignore, tz)
    if measured_bytes(files, "file", "file_index") <= patterns.BROADCAST_BYTES:
        base = merged_aggregates(parsed, files, pos)
        per_file, merged, counts = base.per_file, base.ops, base.patterns
    else:
        # Too many files to give every task their list: kept apart until they are aggregated.
        base = base_aggregates(parsed, PYTHON, by=("file",), pos=pos)
        per_file, merged = base.ops, aggregate.merge_files(base.ops)
        counts = patterns.merge_pattern_counts(base.patterns, files)
    limited = _limited_patterns(parsed, PYTHON, pattern_limit, block, order, ("file",), pos)
    if limited is not None:
        counts = patterns.merge_pattern_counts(limited, files)
    return {
        "file_totals": aggregate.file_totals(per_file, files),
        "totals": aggregate.totals(merged),
        "category_counts": _sections(aggregate.category_counts(merged), MERGED_SECTIONS),
        "concurrency_overall": _sections(aggregate.concurrency_overall(merged), MERGED_SECTIONS),
        "concurrency_all_types": aggregate.concurrency_overall(merged),
        "top_patterns": patterns.top_patterns(counts, merged=True),
        "run_metrics": base.line_counts,
        "pattern_counts": counts,
        "ops_per_second": merged,
    }


def awk_report(
    lines: DataFrame,
    ignore: Sequence[str] = (),
    order: Sequence[str] = ("file", "block_start", "rid"),
    pattern_limit: int | None = None,
    block: Sequence[str] = ("block_start",),
    row_order: str = "rid",
) -> dict[str, DataFrame]:
    """Report of profile A. The reject sample is a second pass, because it returns whole lines."""
    parsed = parse.parse_lines(lines, AWK, ignore)
    base = base_aggregates(parsed, AWK)
    limited = _limited_patterns(parsed, AWK, pattern_limit, block, row_order, (), None)
    counts = base.patterns if limited is None else limited
    rejected = rejects.rejects(parsed, AWK)
    return {
        "totals": aggregate.totals(base.ops, AWK),
        "category_counts": _sections(aggregate.category_counts(base.ops), AWK_SECTIONS),
        "concurrency_overall": _sections(
            aggregate.concurrency_overall(base.ops, AWK), AWK_SECTIONS
        ),
        "concurrency_by_category": _sections(
            aggregate.concurrency_by_category(base.ops, AWK), AWK_SECTIONS
        ),
        "top_patterns": patterns.top_patterns_by_op_type(counts),
        "reject_sample": rejects.reject_sample(rejected, list(order)).select("line"),
        "run_metrics": base.line_counts,
        "pattern_counts": counts,
        "ops_per_second": base.ops,
    }


def shell_report(
    lines: DataFrame, ignore: Sequence[str] = (), tz: str = "UTC"
) -> dict[str, DataFrame]:
    """Report of profile E."""
    parsed = parse.parse_lines(lines, SHELL, ignore, tz)
    base = base_aggregates(parsed, SHELL)
    totals = aggregate.totals(base.ops, SHELL)
    return {
        "totals": totals,
        "category_counts": _sections(aggregate.category_counts(base.ops), SHELL_SECTIONS),
        # This variant lists all five types, in fixed order, zeros included.
        "time_distribution": totals.where(F.col("op_type") != "total").select("op_type", "n"),
        "run_metrics": base.line_counts,
        "ops_per_second": base.ops,
    }


# Tables of a report in long form, with the columns that name a row and the measures it carries.
LONG_FORM = {
    "file_totals": (["file"], ["total_ops", *[f"{t}_ops" for t in fx.OP_TYPES]]),
    "totals": (["op_type"], ["n", "share"]),
    "category_counts": (["op_type", "op_category"], ["n"]),
    "concurrency_overall": (
        ["op_type"], ["max_concurrency", "avg_concurrency", "total_seconds"],
    ),
    "concurrency_by_category": (
        ["op_type", "op_category"],
        ["max_concurrency", "min_concurrency", "avg_concurrency", "total_operations", "active_seconds"],
    ),
    "time_distribution": (["op_type"], ["n"]),
}


def _long_rows(section: str, table: DataFrame, names: list[str], measures: list[str]) -> DataFrame:
    values: list[Column] = [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in measures
    ]
    return table.select(
        F.lit(section).alias("section"),
        F.concat_ws("/", *names).alias("item"),
        F.inline(F.array(*values)),
    )


def report_rows(report: dict[str, DataFrame]) -> DataFrame:
    """A report as ``(section, item, metric, value)`` rows; patterns carry their rank as metric."""
    parts = [
        _long_rows(name, report[name], *LONG_FORM[name]) for name in LONG_FORM if name in report
    ]
    if "top_patterns" in report:
        top = report["top_patterns"]
        group = "pattern_type" if "pattern_type" in top.columns else "op_type"
        parts.append(
            top.select(
                F.lit("top_patterns").alias("section"),
                F.concat_ws("/", group, "pattern").alias("item"),
                F.concat(F.lit("rank "), F.col("rank").cast("string")).alias("metric"),
                F.col("n").cast("double").alias("value"),
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows
