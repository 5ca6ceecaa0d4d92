"""Benchmark: prints one JSON line with seconds per query.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_COPIES
(default 20; how often the larger text log repeats the audit-line view).

* query timings over the audit-line view of the given scale; every result is computed in full;
* ``text_report``: the one-pass single report over text logs that Spark writes from the same view,
  repeated BENCH_COPIES times with other seconds, which gives the throughput in lines per second;
* ``text_two_queries``: the same two aggregates as separate queries, for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from auditlake import build_session  # noqa: E402
from auditlake.operators import aggregate, parse, patterns  # noqa: E402
from auditlake.plans import reports  # noqa: E402
from auditlake.registry.queries import _scratch, queries  # noqa: E402
from auditlake.sources import text  # noqa: E402
from auditlake.sources.events import read_audit_lines  # noqa: E402

HEADLINE = (
    "parse_json_lines",
    "normalize_p",
    "ops_per_second",
    "concurrency_overall",
    "concurrency_by_category",
    "pattern_counts",
    "top_patterns",
    "top_patterns_a",
    "pattern_first_n",
    "file_totals",
    "report_single",
    "report_merged",
    "report_a",
    "stream_ops_per_second",
)


def run(df: DataFrame) -> None:
    df.write.mode("overwrite").format("noop").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def write_logs(spark: SparkSession, sf_dir: str, copies: int, partitions: int) -> str:
    """Text logs with ``copies`` lines per event; copy i is i minutes later."""
    lines = read_audit_lines(spark, sf_dir)
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    later = F.concat(
        F.regexp_extract("line", r"^(.*\|Timestamp=)\d+", 1),
        (F.regexp_extract("line", r"\|Timestamp=(\d+)", 1).try_cast("bigint") + F.col("i") * 60000)
        .cast("string"),
        F.regexp_extract("line", r"\|Timestamp=\d+(.*)$", 1),
    )
    path = _scratch(spark, "bench-logs")
    (
        lines.repartition(partitions)
        .withColumn("i", copy)
        .select(F.coalesce(later, F.col("line")).alias("value"))
        .write.text(path)
    )
    return path


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    copies = int(os.environ.get("BENCH_COPIES", "20"))
    spark = build_session(
        app="auditlake-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__sql__files__maxPartitionBytes="64m",
        spark__driver__memory="16g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    seconds: dict[str, float] = {}
    run(registered["totals"](spark, sf_dir))  # warm up the JVM
    for name in HEADLINE:
        seconds[name] = timed(lambda: run(registered[name](spark, sf_dir)))  # noqa: B023

    path = write_logs(spark, sf_dir, copies, int(cpus) * 2)
    lines = text.with_line_position(text.read_lines(spark, path))
    count = lines.count()

    def report() -> None:
        run(reports.report_rows(reports.single_report(lines, pos="pos")))

    def two_queries() -> None:
        parsed = parse.parse_lines(lines)
        run(aggregate.ops_per_second(parsed))
        run(patterns.pattern_counts(parsed, pos="pos"))

    seconds["text_report"] = timed(report)
    seconds["text_two_queries"] = timed(two_queries)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
                "text_lines": count,
                "text_lines_per_second": round(count / seconds["text_report"]),
            }
        )
    )


if __name__ == "__main__":
    main()
