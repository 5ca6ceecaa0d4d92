"""Counts per second, and everything that is derived from them.

``ops_per_second`` is the only aggregate here that reads log rows. It combines on the map side, so a
task ships at most one row per (category, second) it has seen, whatever the number of log lines; a
category or a second that holds most of the lines therefore does not make a hot task. All other
functions read its small result.

Missing operation types appear as zero rows. Those come from a global aggregate with one conditional
expression per type, turned into rows afterwards: no join, and it also works on empty input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import classify
from auditlake.functions import fixed_values as fx
from auditlake.operators.parse import run_metric_columns, second_text, unparsed_line
from auditlake.profiles import PYTHON, Profile


def ops_per_second(
    parsed: DataFrame, profile: Profile = PYTHON, by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, op_type, op_category, second, n)``: counted statements per second and category.

    Groups by the category alone, because it fixes the operation type, and by the numeric second;
    both are turned into their final form on the aggregated rows.
    """
    cells = (
        parsed.groupBy(*by, "op_category", "second_key")
        .agg(F.count("op_category").alias("n"))
        .where(F.col("n") > 0)
    )
    return finish_cells(cells, profile, by)


def finish_cells(cells: DataFrame, profile: Profile, by: Sequence[str] = ()) -> DataFrame:
    """Operation type and second text for aggregated ``(op_category, second_key, n)`` rows."""
    return cells.select(
        *by,
        classify.op_type_of("op_category").alias("op_type"),
        "op_category",
        second_text(profile).alias("second"),
        "n",
    )


def merge_files(ops: DataFrame) -> DataFrame:
    """Per-file counts added up: ``(op_type, op_category, second, n)``."""
    return ops.groupBy("op_type", "op_category", "second").agg(F.sum("n").alias("n"))


def _per_type_rows(df: DataFrame, measures: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per operation type, always all of them.

    ``measures`` maps output names to functions of the count column; each is applied to the counts
    of one type, and a null result (no row of that type) becomes 0.
    """
    of_type = {t: F.when(F.col("op_type") == t, F.col("n")) for t in fx.OP_TYPES}
    wide = df.agg(
        *[
            F.coalesce(measure(of_type[t]), F.lit(0)).alias(f"{t}_{name}")
            for t in fx.OP_TYPES
            for name, measure in measures.items()
        ]
    )
    rows = [
        F.struct(F.lit(t).alias("op_type"), *[F.col(f"{t}_{name}").alias(name) for name in measures])
        for t in fx.OP_TYPES
    ]
    return wide.select(F.inline(F.array(*rows)))


def totals(ops: DataFrame, profile: Profile = PYTHON) -> DataFrame:
    """``(op_type, n, share)``: always five rows and a ``total`` row; share in percent.

    Profile A cuts the share to one decimal; an empty log has share 0.
    """
    count_of = {t: F.sum(F.when(F.col("op_type") == t, F.col("n"))) for t in fx.OP_TYPES}
    count_of["total"] = F.sum("n")
    wide = ops.agg(*[F.coalesce(c, F.lit(0)).alias(t) for t, c in count_of.items()])
    rows = F.array(*[F.struct(F.lit(t).alias("op_type"), F.col(t).alias("n")) for t in count_of])
    if profile.truncate_stats:
        share = F.floor(F.col("n") * 1000 / F.col("all_ops")) / 10
    else:
        share = F.col("n") * 100 / F.col("all_ops")
    return wide.select(F.col("total").alias("all_ops"), F.inline(rows)).select(
        "op_type",
        "n",
        F.when(F.col("all_ops") > 0, share).otherwise(F.lit(0.0)).alias("share"),
    )


def category_counts(ops: DataFrame) -> DataFrame:
    """``(op_type, op_category, n)``, largest first within each operation type."""
    return (
        ops.groupBy("op_type", "op_category")
        .agg(F.sum("n").alias("n"))
        .orderBy("op_type", F.desc("n"), F.desc("op_category"))
    )


def time_distribution(ops: DataFrame) -> DataFrame:
    """``(op_type, n)`` of the types that occur, largest first."""
    return ops.groupBy("op_type").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "op_type")


def _average(total: Column, seconds: Column, profile: Profile) -> Column:
    """Mean per active second, null without any; profile A cuts it to two decimals."""
    seconds = F.nullif(seconds, F.lit(0))
    if profile.truncate_stats:
        return F.floor(total * 100 / seconds) / 100
    return total / seconds


def concurrency_overall(ops: DataFrame, profile: Profile = PYTHON) -> DataFrame:
    """``(op_type, max_concurrency, avg_concurrency, total_seconds)``, zeros for absent types.

    ``total_seconds`` counts seconds in which the type occurs. Files are merged by the first step.
    """
    per_second = ops.groupBy("op_type", "second").agg(F.sum("n").alias("n"))
    return _per_type_rows(
        per_second,
        {
            "max_concurrency": F.max,
            "avg_concurrency": lambda n: _average(F.sum(n), F.count(n), profile),
            "total_seconds": F.count,
        },
    )


def concurrency_by_category(
    ops: DataFrame, profile: Profile = PYTHON, merged: bool = True
) -> DataFrame:
    """Concurrency of every category over the seconds in which it occurs.

    ``merged=False`` says that ``ops`` still has rows of several files to add up.
    """
    cells = ops if merged else merge_files(ops)
    return (
        cells.groupBy("op_type", "op_category")
        .agg(
            F.max("n").alias("max_concurrency"),
            F.min("n").alias("min_concurrency"),
            _average(F.sum("n"), F.count("n"), profile).alias("avg_concurrency"),
            F.sum("n").alias("total_operations"),
            F.count("n").alias("active_seconds"),
        )
        .orderBy("op_type", F.desc("total_operations"), "op_category")
    )


def file_totals(ops: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``(file, total_ops, read_ops, ...)``; files of ``files`` without any record show zeros.

    A file that has records and is not in ``files`` still shows, with file index -1.
    """
    counts = ops.groupBy("file").agg(
        F.sum("n").alias("total_ops"),
        *[F.sum(F.when(F.col("op_type") == t, F.col("n")).otherwise(0)).alias(f"{t}_ops")
          for t in fx.OP_TYPES],
    )
    if files is None:
        return counts
    listed = files.join(counts, "file", "left").na.fill(0, counts.columns)
    others = counts.join(files.select("file"), "file", "left_anti")
    if "file_index" in files.columns:
        others = others.withColumn("file_index", F.lit(-1).cast("bigint"))
    # A file status carries more columns, which files outside the list do not have.
    return listed.unionByName(others, allowMissingColumns=True)


def run_metrics(parsed: DataFrame, profile: Profile = PYTHON) -> DataFrame:
    """One row of line counts; ``unparsed`` counts the lines that the profile lists as rejects."""
    unparsed = F.count_if(unparsed_line(profile)).alias("unparsed")
    return parsed.agg(*run_metric_columns(), unparsed)
