"""Result files of the reports.

A result is a folder. ``result`` holds one JSON object with the bounded parts (totals, at most 22
categories, concurrency). Parts that grow with the logs, which are the pattern dictionary and the
per-file totals, are written as JSON lines in folders beside it, in parallel and always whole. The
object names these folders, and has the same fields at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import fixed_values as fx

OVERALL = ("max_concurrency", "avg_concurrency", "total_seconds")
BY_CATEGORY = (
    "max_concurrency", "min_concurrency", "avg_concurrency", "total_operations", "active_seconds",
)


# Files that a read names one by one; beyond that it goes by the type's folder.
MAX_NAMED_FILES = 10_000


def _write_lines(df: DataFrame, path: str) -> DataFrame:
    """Write as JSON lines and read back, so that later steps do not compute the rows again."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def _kind(name: str, df: DataFrame) -> DataFrame:
    return df.withColumn("kind", F.lit(name))


def _one_row(parts: Sequence[DataFrame]) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows


def _pick(kind: str, op_type: str, value: Column) -> Column:
    """The value of the single row of this kind and type."""
    here = (F.col("kind") == kind) & (F.col("op_type") == op_type)
    return F.first(F.when(here, value), ignorenulls=True)


def _map_of(condition: Column, key: str, value: Column) -> Column:
    return F.map_from_entries(F.collect_list(F.when(condition, F.struct(F.col(key), value))))


def _summary() -> Column:
    names = {"total": "total_operations", **{t: f"{t}_operations" for t in fx.OP_TYPES}}
    return F.struct(*[_pick("totals", t, F.col("n")).alias(name) for t, name in names.items()])


def _overall(op_type: str) -> Column:
    return _pick("overall", op_type, F.struct(*OVERALL)).alias("overall")


def write_result(report: dict[str, DataFrame], path: str) -> None:
    """Result of a single log: summary, five sections, patterns, line counts of the run."""
    counts = report["pattern_counts"].select("pattern", "n")
    counts.write.mode("overwrite").json(f"{path}/sql_patterns")

    parts = [
        _kind("totals", report["totals"]),
        _kind("overall", report["concurrency_overall"]),
        _kind("category", report["concurrency_by_category"]),
        _kind("run", report["run_metrics"]),
    ]
    def section(op_type: str) -> Column:
        here = (F.col("kind") == "category") & (F.col("op_type") == op_type)
        detail = _map_of(here, "op_category", F.struct(*BY_CATEGORY)).alias("by_type")
        return F.struct(
            _map_of(here, "op_category", F.col("total_operations")).alias("by_type"),
            F.struct(_overall(op_type), detail).alias("concurrency"),
        ).alias(f"{op_type}_operations")

    run = ("lines", "parsed", "operations", "ignored", "rejected", "unparsed")
    monitoring = F.struct(
        *[F.first(F.when(F.col("kind") == "run", F.col(c)), ignorenulls=True).alias(c) for c in run]
    ).alias("processing_monitoring")
    result = _one_row(parts).agg(
        _summary().alias("summary"),
        *[section(t) for t in fx.OP_TYPES],
        F.lit("sql_patterns").alias("sql_patterns_folder"),
        monitoring,
    )
    result.write.mode("overwrite").json(f"{path}/result")


def write_ordered(table: DataFrame, order: str, path: str) -> None:
    """JSON lines in the order of a column: tasks write ranges of it, so part files follow one another."""
    table.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").json(path)


def write_merged_result(
    report: dict[str, DataFrame], path: str, arguments: DataFrame | None = None
) -> None:
    """Result of several logs: file list with totals, merged summary and concurrency, patterns.

    ``arguments`` is ``(file, position)`` in argument order, a file that was named twice twice. It is
    written as ``files`` in that order; without it the order of ``file_index`` counts.
    """
    merged = report["pattern_counts"].select("pattern", "n")
    merged.write.mode("overwrite").json(f"{path}/combined_sql_patterns")
    files = _write_lines(report["file_totals"], f"{path}/file_stats")
    if arguments is None:
        arguments = files.select("file", F.col("file_index").alias("position"))
    write_ordered(arguments.select("position", "file"), "position", f"{path}/files")

    parts = [
        _kind("totals", report["totals"]),
        _kind("overall", report["concurrency_all_types"]),
        _kind("files", arguments.agg(F.count(F.lit(1)).alias("total_files"))),
    ]
    file_info = [F.max("total_files").alias("total_files"), F.lit("files").alias("files_folder"), F.lit("file_stats").alias("file_stats_folder")]
    result = _one_row(parts).agg(
        F.struct(*file_info).alias("file_info"),
        _summary().alias("combined_summary"),
        *[
            F.struct(F.struct(_overall(t)).alias("concurrency")).alias(f"combined_{t}_operations")
            for t in fx.OP_TYPES
        ],
        F.lit("combined_sql_patterns").alias("sql_patterns_folder"),
    )
    result.write.mode("overwrite").json(f"{path}/result")


def write_summary(
    report: dict[str, DataFrame],
    path: str,
    log_file: str,
    ignore: Sequence[str] = (),
    pattern_limit: int = 0,
    shell: bool = False,
) -> None:
    """Short summary of profile A, or of profile E (``shell``) with its count of unparsed lines."""
    parameters = [
        F.lit(log_file).alias("log_file"),
        F.lit(pattern_limit).alias("pattern_limit"),
        F.array(*[F.lit(p) for p in ignore]).cast("array<string>").alias("ignore_patterns"),
    ]
    parts = [_kind("totals", report["totals"])]
    stamp = F.current_timestamp().alias("analysis_timestamp")
    if not shell:
        result = _one_row(parts).agg(_summary().alias("summary")).select("summary", stamp, *parameters)
    else:
        # Ignored statements count as unparsed in this variant.
        parts.append(_kind("run", report["run_metrics"]))
        result = (
            _one_row(parts)
            .agg(_summary().alias("summary"), F.max(F.col("ignored") + F.col("rejected")).alias("u"))
            .select(
                "summary",
                F.struct(*parameters, F.col("u").alias("unparsed_sql_count")).alias("processing_info"),
                stamp,
            )
        )
    result.write.mode("overwrite").json(path)


def write_run_metrics(counts: DataFrame, path: str, stage: str, elapsed: float) -> None:
    """Line counts of a run as a CSV with one row.

    ``counts`` is ``run_metrics`` of a report, which is added up from the stored base table: every line is in
    it once, however often a task was repeated. Counts that tasks report on the way could include a task
    that ran twice.
    """
    (
        counts.select(F.lit(stage).alias("stage"), "*", F.lit(float(elapsed)).alias("elapsed"))
        .withColumn("timestamp", F.current_timestamp())
        .write.mode("overwrite")
        .csv(path, header=True)
    )


def write_rejects(rejected: DataFrame, path: str) -> None:
    """Rejected lines as text, one part file per task."""
    rejected.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_parsed(parsed: DataFrame, path: str) -> None:
    """Counted records as Parquet, one folder per operation type.

    No shuffle: every task writes its own rows, so a type that holds most rows is still written by
    all tasks, and later queries on one type read only its folder. For queries on a range of time see
    ``write_clustered``.
    """
    parsed.where(F.col("reject_reason").isNull()).write.mode("overwrite").partitionBy(
        "op_type"
    ).parquet(path)


def write_clustered(parsed: DataFrame, path: str, files: int | None = None) -> None:
    """Counted records clustered by operation type and second, with an index of the files' ranges.

    One range shuffle puts neighbouring seconds of a type into the same file; rows of one second spread
    by their place in the input, so a hot second can fill several files. There are about ``files`` files
    (default: the shuffle partitions that hold data) and one more per type, whatever the number of
    tasks that read the logs. ``index`` has the least and largest second of every file; it is written
    from the files themselves, of which it reads one column.
    """
    spark = parsed.sparkSession
    rows = parsed.where(F.col("reject_reason").isNull()).withColumn("_row", F.monotonically_increasing_id())
    order = ("op_type", "second_key", "_row")
    ranged = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).drop("_row").write.mode("overwrite").partitionBy("op_type").parquet(f"{path}/rows")
    (
        spark.read.parquet(f"{path}/rows")
        .groupBy("op_type", F.col("_metadata.file_name").alias("name"))
        .agg(F.min("second_key").alias("low"), F.max("second_key").alias("high"), F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .parquet(f"{path}/index")
    )


def read_clustered(
    spark: SparkSession, path: str, op_type: str, low: int | str, high: int | str
) -> DataFrame:
    """Records of one type with ``low <= second_key <= high``, from the files whose range meets it."""
    meets = (F.col("op_type") == op_type) & (F.col("low") <= high) & (F.col("high") >= low)
    index = spark.read.parquet(f"{path}/index").where(meets)
    wanted = (F.col("op_type") == op_type) & F.col("second_key").between(low, high)
    rows = spark.read.parquet(f"{path}/rows").where(wanted)
    if index.count() <= MAX_NAMED_FILES:
        # A condition on file names alone: Spark applies it to the list of files, before any is opened.
        rows = rows.where(F.col("_metadata.file_name").isin([r.name for r in index.select("name").collect()]))
    # A wider range reads all files of the type and lets their footers decide.
    return rows
