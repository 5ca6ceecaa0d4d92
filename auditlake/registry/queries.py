"""One query per operator over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import fixed_values as fx
from auditlake.functions import normalize
from auditlake.operators import aggregate, parse, patterns, rejects
from auditlake.plans import reports
from auditlake.plans.base import base_aggregates
from auditlake.profiles import AWK, PYTHON, SHELL, Profile
from auditlake.registry.oracle import DELAY_DAYS, FIRST_MANY, FIRST_N, IGNORE
from auditlake.session import qualified, shared_dir
from auditlake.sinks import results
from auditlake.sources import text
from auditlake.sources.events import audit_lines, read_audit_lines, read_edge_lines
from auditlake.streaming import ops as stream

Query = Callable[[SparkSession, str], DataFrame]
EVENTS_PER_BLOCK = 4096


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/auditlake/{name}-{uuid.uuid4().hex}"


def _parsed(
    spark: SparkSession, sf_dir: str, profile: Profile = PYTHON, ignore: Sequence[str] = ()
) -> DataFrame:
    return parse.parse_lines(read_audit_lines(spark, sf_dir), profile, ignore)


def _ops(spark: SparkSession, sf_dir: str, profile: Profile = PYTHON, **kw) -> DataFrame:
    by = kw.pop("by", ())
    return aggregate.ops_per_second(_parsed(spark, sf_dir, profile, **kw), profile, by)


def _record_columns(parsed: DataFrame, profile: Profile = PYTHON) -> DataFrame:
    return parse.records(parsed).select(
        "event_id",
        F.unix_millis("ts").alias("ts_ms"),
        parse.second_text(profile).alias("second"),
        "stmt",
        "execution_time",
    )


def _parse(profile: Profile, json: bool | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = _parsed(spark, sf_dir, profile)
        if json is not None:
            parsed = parsed.where(F.col("line").startswith("{") == F.lit(json))
        return _record_columns(parsed, profile)

    return query


def _kept(profile: Profile) -> Query:
    return lambda s, d: parse.records(_parsed(s, d, profile, IGNORE)).select("event_id", "stmt")


def _classified(profile: Profile) -> Query:
    return lambda s, d: parse.records(_parsed(s, d, profile)).select(
        "event_id", "op_type", "op_category"
    )


def _normalized(profile: Profile, variant: str) -> Query:
    return lambda s, d: parse.records(_parsed(s, d, profile)).select(
        "event_id", normalize.normalize(F.col("stmt"), variant).alias("pattern")
    )


def _in_blocks(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("block", F.floor(F.col("event_id") / EVENTS_PER_BLOCK))


def _file_order(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(str(i), i) for i in range(3)], "file string, file_index bigint"
    )


def _top_patterns_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_file = patterns.pattern_counts(_parsed(spark, sf_dir), by=("file",), pos="event_id")
    counts = patterns.merge_pattern_counts(per_file, _file_order(spark))
    return patterns.top_patterns(counts, merged=True)


def _pattern_first_n(limit: int, profile: Profile = PYTHON) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = _in_blocks(_parsed(spark, sf_dir, profile))
        first = patterns.first_records(parsed, limit, ["block"], "event_id", profile=profile)
        return patterns.pattern_counts(first, profile)

    return query


def _reject_rows(profile: Profile) -> Query:
    return lambda s, d: rejects.rejects(_parsed(s, d, profile, IGNORE), profile).select(
        "event_id", "line"
    )


def _reject_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = rejects.rejects(_parsed(spark, sf_dir, AWK, IGNORE), AWK)
    return rejects.reject_sample(rejected, ["event_id"]).select("event_id", "line")


def _metrics(profile: Profile) -> Query:
    return lambda s, d: aggregate.run_metrics(_parsed(s, d, profile, IGNORE), profile)


def _sections(df: DataFrame, op_types: Sequence[str]) -> DataFrame:
    return df.where(F.col("op_type").isin(list(op_types)))


# ---- Reports -----------------------------------------------------------------------------------


def _single(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return reports.single_report(read_audit_lines(spark, sf_dir), pos="event_id")


def _merged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    lines = read_audit_lines(spark, sf_dir)
    return reports.merged_report(lines, _file_order(spark), pos="event_id")


def _awk(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return reports.awk_report(read_audit_lines(spark, sf_dir), IGNORE, order=["event_id"])


def _shell(
    spark: SparkSession, sf_dir: str, ignore: Sequence[str] = ()
) -> dict[str, DataFrame]:
    return reports.shell_report(read_audit_lines(spark, sf_dir), ignore)


# ---- Sinks, read back --------------------------------------------------------------------------


def _section_rows(result: DataFrame, prefix: str, summary: str, extra: Sequence) -> DataFrame:
    def row(op_type: str) -> Column:
        section = F.col(f"{prefix}{op_type}_operations")
        overall = section["concurrency"]["overall"]
        return F.struct(
            F.lit(op_type).alias("op_type"),
            F.col(summary)[f"{op_type}_operations"].alias("total"),
            *[overall[c].alias(c) for c in results.OVERALL],
            *[e(section) for e in extra],
        )

    return result.select(F.inline(F.array(*[row(t) for t in fx.OP_TYPES])))


def _result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "result")
    results.write_result(_single(spark, sf_dir), path)
    counts = "map<string,bigint>"
    detail = (
        "map<string,struct<max_concurrency:bigint,min_concurrency:bigint,avg_concurrency:double,"
        "total_operations:bigint,active_seconds:bigint>>"
    )
    overall = "struct<max_concurrency:bigint,avg_concurrency:double,total_seconds:bigint>"
    section = f"struct<by_type:{counts},concurrency:struct<overall:{overall},by_type:{detail}>>"
    names = ["total", *fx.OP_TYPES]
    schema = "summary struct<" + ",".join(f"{n}_operations:bigint" for n in names) + ">"
    schema += "".join(f", {t}_operations {section}" for t in fx.OP_TYPES)
    result = spark.read.schema(schema).json(f"{path}/result")
    categories = lambda s: F.size(s["by_type"]).cast("bigint").alias("categories")
    return _section_rows(result, "", "summary", [categories])


def _result_json_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "merged")
    # Not in the order of the names, and one named twice.
    arguments = spark.createDataFrame([(f, n) for n, f in enumerate("2010")], "file string, position bigint")
    results.write_merged_result(_merged(spark, sf_dir), path, arguments)
    overall = "struct<max_concurrency:bigint,avg_concurrency:double,total_seconds:bigint>"
    names = ["total", *fx.OP_TYPES]
    schema = "file_info struct<total_files:bigint>, combined_summary struct<"
    schema += ",".join(f"{n}_operations:bigint" for n in names) + ">"
    schema += "".join(
        f", combined_{t}_operations struct<concurrency:struct<overall:{overall}>>"
        for t in fx.OP_TYPES
    )
    result = spark.read.schema(schema).json(f"{path}/result")
    # As they stand in the part files.
    written = spark.read.schema("position bigint, file string").json(f"{path}/files")
    place = F.struct(F.col("_metadata.file_name").alias("part"), F.monotonically_increasing_id().alias("row"), "file")
    in_order = written.select(place.alias("p")).agg(F.array_sort(F.collect_list("p")).alias("p"))
    names = in_order.select(F.array_join(F.transform("p", lambda x: x["file"]), ",").alias("files")).first()[0]
    more = [lambda s: F.col("file_info")["total_files"].alias("total_files"), lambda s: F.lit(names).alias("files")]
    return _section_rows(result, "combined_", "combined_summary", more)


def _summary_schema() -> str:
    names = ["total", *fx.OP_TYPES]
    return "summary struct<" + ",".join(f"{n}_operations:bigint" for n in names) + ">"


def _summary_json_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "summary")
    results.write_summary(_awk(spark, sf_dir), path, sf_dir, IGNORE)
    return spark.read.schema(_summary_schema()).json(path).select("summary.*")


def _summary_json_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "summary")
    results.write_summary(_shell(spark, sf_dir, IGNORE), path, sf_dir, IGNORE, shell=True)
    schema = _summary_schema() + ", processing_info struct<unparsed_sql_count:bigint>"
    read = spark.read.schema(schema).json(path)
    return read.select("summary.*", "processing_info.unparsed_sql_count")


def _pattern_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "dictionary")
    counts = patterns.pattern_counts(_parsed(spark, sf_dir)).select("pattern", "n")
    counts.write.json(path)
    return spark.read.schema("pattern string, n bigint").json(path)


def _parsed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "parsed")
    results.write_parsed(_parsed(spark, sf_dir), path)
    return spark.read.parquet(path).select(
        "event_id", "op_type", "op_category", parse.second_text().alias("second"), "execution_time"
    )


def _parsed_table_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "clustered")
    results.write_clustered(_parsed(spark, sf_dir), path)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    low = events.agg(F.unix_date(F.min("ts").cast("date"))).first()[0] * 86400
    return results.read_clustered(spark, path, "write", low, low + 86399).select(
        "event_id", "op_category", parse.second_text().alias("second"), "execution_time"
    )


def _edge_records(profile: Profile) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = read_edge_lines(spark, sf_dir)
        return parse.records(parse.parse_lines(lines, profile, IGNORE)).select(
            "event_id",
            "op_type",
            "op_category",
            F.char_length("stmt").cast("bigint").alias("stmt_chars"),
            "execution_time",
            normalize.normalize(F.col("stmt"), profile.name).alias("pattern"),
        )

    return query


def _edge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_edge_lines(spark, sf_dir)
    return aggregate.run_metrics(parse.parse_lines(lines, PYTHON, IGNORE), PYTHON)


def _observed_metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "metrics")
    started = time.time()
    report = base_aggregates(_parsed(spark, sf_dir, PYTHON, IGNORE), PYTHON)
    results.write_run_metrics(report.line_counts, f"{path}/csv", "done", time.time() - started)
    columns = ("lines", "parsed", "operations", "ignored", "rejected", "unparsed")
    read = spark.read.option("header", "true").csv(f"{path}/csv")
    return read.select(*[F.col(c).cast("bigint").alias(c) for c in columns])


# ---- Text files --------------------------------------------------------------------------------


def write_text_logs(spark: SparkSession, sf_dir: str) -> str:
    """The audit-line view as text logs, one folder per log, lines in order of ``event_id``.

    Range partitioning lets several tasks share a large log and still write its parts in order.
    """
    root = _scratch(spark, "logs")
    (
        read_audit_lines(spark, sf_dir)
        .withColumnRenamed("file", "log")
        .repartitionByRange("log", "event_id")
        .sortWithinPartitions("log", "event_id")
        .select("log", F.col("line").alias("value"))
        .write.partitionBy("log")
        .text(root)
    )
    return root


def _text_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    root = write_text_logs(spark, sf_dir)
    paths = [f"{root}/log={i}" for i in range(3)]
    lines = text.with_line_position(text.read_lines(spark, paths))
    return lines, paths


def _log_name(file: str = "file") -> Column:
    return F.regexp_extract(file, "log=([^/]+)", 1)


def _text_file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = _text_lines(spark, sf_dir)
    parsed = parse.parse_lines(lines.withColumn("file", _log_name()))
    return aggregate.file_totals(aggregate.ops_per_second(parsed, by=("file",)))


def _text_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = _text_lines(spark, sf_dir)
    per_file = aggregate.ops_per_second(parse.parse_lines(lines), by=("file",))
    return aggregate.merge_files(per_file)


def _text_top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, paths = _text_lines(spark, sf_dir)
    per_file = patterns.pattern_counts(parse.parse_lines(lines), by=("file",), pos="pos")
    counts = patterns.merge_pattern_counts(per_file, text.file_list(spark, paths))
    return patterns.top_patterns(counts, merged=True)


def _text_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = _text_lines(spark, sf_dir)
    # Part files of one folder are one log; its blocks are ordered by part file, then by split.
    logs = lines.withColumn("part", F.col("file")).withColumn("file", _log_name())
    parsed = parse.parse_lines(logs)
    first = patterns.first_records(parsed, FIRST_N, ["part", "block_start"], "rid")
    return patterns.pattern_counts(first)


def _cut_logs(lines: DataFrame, folder: str) -> DataFrame:
    """Write ``line`` as gzip files that end too early; returns their names."""

    def write(batches):
        import gzip

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for number, batch in enumerate(batches):
            packed = gzip.compress("\n".join(batch.column(0).to_pylist()).encode())
            name = f"{root}/part-{TaskContext.get().partitionId():05d}-{number:05d}.gz"
            with store.open_output_stream(name, compression=None) as out:
                out.write(packed[: len(packed) * 2 // 3])
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return lines.select("line").mapInArrow(write, "name string")


def _text_skipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text logs, and a copy of the first one of which every file is cut: it counts nothing."""
    root = write_text_logs(spark, sf_dir)
    cut = read_audit_lines(spark, sf_dir).where("file = '0'")
    _cut_logs(cut, qualified(spark, f"{root}/log=3")).count()
    paths = [f"{root}/log={i}" for i in range(4)]
    status = text.file_status(spark, paths)
    lines = text.read_lines(spark, paths, status=status)
    ops = aggregate.ops_per_second(parse.parse_lines(lines), by=("file",))
    totals = aggregate.file_totals(ops, status).withColumn("file", _log_name())
    measures = ["total_ops", *[f"{t}_ops" for t in fx.OP_TYPES]]
    skipped = (F.count("reason") == F.count(F.lit(1))).alias("skipped")
    return totals.groupBy("file").agg(*[F.sum(m).alias(m) for m in measures], skipped)


def _text_rejects_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "rejects")
    rejected = rejects.rejects(_parsed(spark, sf_dir, SHELL, IGNORE), SHELL)
    results.write_rejects(rejected, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# ---- Streams -----------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return audit_lines(events.parquet(sf_dir))


def _stream_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _scratch(spark, "stream")
    query = stream.append_counts(_event_stream(spark, sf_dir), f"{root}/out", f"{root}/state")
    query.awaitTermination()
    return stream.read_counts(spark, f"{root}/out")


def _stream_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _scratch(spark, "stream")
    counts = stream.windowed_counts(_event_stream(spark, sf_dir), delay="10 minutes")
    stream.write_windowed(counts, f"{root}/out", f"{root}/state").awaitTermination()
    return stream.read_windowed(spark, f"{root}/out")


def _stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries with checkpoints of their own add the text logs to one folder, several files a batch."""
    logs, root = write_text_logs(spark, sf_dir), _scratch(spark, "stream")
    for name, folders in (("first", "log=[01]"), ("second", "log=2")):
        lines = spark.readStream.option("maxFilesPerTrigger", 3).text(f"{logs}/{folders}")
        counted = lines.select(F.col("value").alias("line"))
        stream.append_counts(counted, f"{root}/out", f"{root}/{name}").awaitTermination()
    return stream.read_counts(spark, f"{root}/out")


def _stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with even identifiers come first, the odd ones in a second run of the same query."""
    root, delay = _scratch(spark, "stream"), f"{DELAY_DAYS} days"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.parquet(f"{root}/in/part={part}")
        lines = audit_lines(spark.readStream.schema(events.schema).parquet(f"{root}/in/part=*"))
        stream.ledger_counts(lines, f"{root}/out", f"{root}/state", delay).awaitTermination()
    return stream.read_ledger(spark, f"{root}/out", delay)


def queries() -> dict[str, Query]:
    return {
        "parse_json_lines": _parse(PYTHON, json=True),
        "parse_traditional_lines": _parse(PYTHON, json=False),
        "parse_a_lines": _parse(AWK),
        "parse_e_lines": _parse(SHELL),
        "ignore_filter": _kept(PYTHON),
        "ignore_filter_a": _kept(AWK),
        "ignore_filter_e": _kept(SHELL),
        "classify_p": _classified(PYTHON),
        "classify_a": _classified(AWK),
        "classify_e": _classified(SHELL),
        "normalize_p": _normalized(PYTHON, "P"),
        "normalize_a": _normalized(AWK, "A"),
        "normalize_e": _normalized(SHELL, "E"),
        "normalize_aggressive": _normalized(AWK, "aggressive"),
        "ops_per_second": _ops,
        "ops_per_second_a": lambda s, d: _ops(s, d, AWK),
        "totals": lambda s, d: aggregate.totals(_ops(s, d)),
        "op_share": lambda s, d: aggregate.totals(_ops(s, d, ignore=IGNORE)),
        "op_share_a": lambda s, d: aggregate.totals(_ops(s, d, AWK, ignore=IGNORE), AWK),
        "category_counts": lambda s, d: aggregate.category_counts(_ops(s, d)),
        "category_counts_a": lambda s, d: _sections(
            aggregate.category_counts(_ops(s, d, AWK)), reports.AWK_SECTIONS
        ),
        "category_counts_e": lambda s, d: _sections(
            aggregate.category_counts(_ops(s, d, SHELL)), reports.SHELL_SECTIONS
        ),
        "time_distribution": lambda s, d: aggregate.time_distribution(_ops(s, d)),
        "concurrency_overall": lambda s, d: aggregate.concurrency_overall(_ops(s, d)),
        "concurrency_overall_a": lambda s, d: aggregate.concurrency_overall(_ops(s, d, AWK), AWK),
        "concurrency_by_category": lambda s, d: aggregate.concurrency_by_category(_ops(s, d)),
        "concurrency_by_category_a": lambda s, d: aggregate.concurrency_by_category(
            _ops(s, d, AWK), AWK
        ),
        "pattern_counts": lambda s, d: patterns.pattern_counts(_parsed(s, d), pos="event_id"),
        "pattern_counts_a": lambda s, d: patterns.pattern_counts(_parsed(s, d, AWK), AWK),
        "top_patterns": lambda s, d: patterns.top_patterns(
            patterns.pattern_counts(_parsed(s, d), pos="event_id")
        ),
        "top_patterns_multi": _top_patterns_multi,
        "top_patterns_a": lambda s, d: patterns.top_patterns_by_op_type(
            patterns.pattern_counts(_parsed(s, d, AWK), AWK)
        ),
        "pattern_first_n": _pattern_first_n(FIRST_N),
        "pattern_first_n_a": _pattern_first_n(FIRST_N, AWK),
        "pattern_first_n_many": _pattern_first_n(FIRST_MANY),
        "file_totals": lambda s, d: aggregate.file_totals(_ops(s, d, by=("file",))),
        "merged_totals": lambda s, d: aggregate.totals(
            aggregate.merge_files(_ops(s, d, by=("file",)))
        ),
        "rejects_a": _reject_rows(AWK),
        "rejects_e": _reject_rows(SHELL),
        "reject_sample": _reject_sample,
        "run_metrics": _metrics(PYTHON),
        "run_metrics_a": _metrics(AWK),
        "run_metrics_e": _metrics(SHELL),
        "observed_metrics_csv": _observed_metrics_csv,
        "report_single": lambda s, d: reports.report_rows(_single(s, d)),
        "report_merged": lambda s, d: reports.report_rows(_merged(s, d)),
        "report_a": lambda s, d: reports.report_rows(_awk(s, d)),
        "report_e": lambda s, d: reports.report_rows(_shell(s, d)),
        "result_json": _result_json,
        "result_json_merged": _result_json_merged,
        "summary_json_a": _summary_json_a,
        "summary_json_e": _summary_json_e,
        "pattern_dictionary": _pattern_dictionary,
        "parsed_table": _parsed_table,
        "parsed_table_range": _parsed_table_range,
        "edge_records_p": _edge_records(PYTHON),
        "edge_records_a": _edge_records(AWK),
        "edge_records_e": _edge_records(SHELL),
        "edge_metrics_p": _edge_metrics,
        "text_file_totals": _text_file_totals,
        "text_skipped_files": _text_skipped_files,
        "text_ops_per_second": _text_ops,
        "text_top_patterns": _text_top_patterns,
        "text_first_n": _text_first_n,
        "text_rejects_e": _text_rejects_e,
        "stream_ops_per_second": _stream_ops,
        "stream_windowed_ops": _stream_windowed,
        "stream_text_ops": _stream_text,
        "stream_late_ledger": _stream_late,
    }
