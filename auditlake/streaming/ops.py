"""Counts per second over a stream of log lines.

Counts are additive, so every micro-batch writes its own counts and they are added up when they are read. No
state is kept between batches, and no line is ever dropped.

* ``append_counts`` keeps counts per second.
* ``ledger_counts`` also decides, by a watermark, which lines came late. It is a two-way split: lines in
  time and lines behind the watermark both stay, under their own mark, so closed, open and late counts add up
  to all lines.
* ``windowed_counts`` keeps windows in Spark's state store instead; lines behind the watermark are dropped
  there, as Spark's windows do.

**Exactly once.** A batch is written to a folder of its own attempt, named by query identifier and batch, and
then a one-row manifest entry of this batch is written, which names the attempt. Readers see only what
the manifest names. A batch that is repeated after its commit is skipped, one that is repeated before its commit
writes another attempt, and a query with a new checkpoint has a new identifier, so it adds to a folder
that older queries wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlake.operators import aggregate, parse
from auditlake.profiles import PYTHON, Profile

BATCH_KEYS = "query string, batch bigint, attempt string"
OPS = "op_type string, op_category string, second string, n bigint"
LEDGER = "op_category string, second_key {key}, epoch_second bigint, late boolean, n bigint, high bigint"
WINDOWS = "start timestamp, op_category string, second_key {key}, n bigint"


def _key_type(profile: Profile) -> str:
    return "string" if profile.name == "A" else "bigint"


# ---- Committed batches -------------------------------------------------------------------------


def query_id(spark: SparkSession, checkpoint_dir: str) -> str:
    """Identifier of the query that owns a checkpoint; it stays the same when the query restarts."""
    return spark.read.schema("id string").json(f"{checkpoint_dir}/metadata").first().id


def _read_or_empty(spark: SparkSession, kind: str, path: str, schema: str) -> DataFrame:
    """A folder that perhaps no batch has made yet."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """``(attempt, high, query, batch)`` of all committed batches; ``high`` is the latest event time in
    microseconds, null where none was asked for."""
    schema = "attempt string, high bigint, query string, batch bigint"
    return _read_or_empty(spark, "json", f"{out_dir}/manifest", schema)


def commit_batch(counts: DataFrame, out_dir: str, query: str, batch_id: int) -> bool:
    """Write the counts of a batch and then its manifest entry; False if the batch is committed already."""
    spark = counts.sparkSession
    mine = (F.col("query") == query) & (F.col("batch") == batch_id)
    if not manifest(spark, out_dir).where(mine).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    path = f"{out_dir}/data/query={query}/batch={batch_id}/attempt={attempt}"
    counts.write.parquet(path)
    stored = spark.read.schema(counts.schema).parquet(path)
    high = F.max("high") if "high" in counts.columns else F.lit(None).cast("bigint")
    # One row; the entry is what makes the batch count, so it comes last.
    stored.agg(F.lit(attempt).alias("attempt"), high.alias("high")).write.mode("overwrite").json(
        f"{out_dir}/manifest/query={query}/batch={batch_id}"
    )
    return True


def committed(spark: SparkSession, out_dir: str, schema: str) -> DataFrame:
    """All rows of committed batches, with ``query`` and ``batch``; none if nothing was committed."""
    rows = _read_or_empty(spark, "parquet", f"{out_dir}/data", f"{schema}, {BATCH_KEYS}")
    # One manifest row per batch; the keys are folders, so attempts without a commit are not read.
    return rows.join(manifest(spark, out_dir).drop("high"), ["query", "batch", "attempt"], "left_semi").drop("attempt")


def _start(
    lines: DataFrame, checkpoint_dir: str, write_batch: Callable[[DataFrame, int, str], None], mode: str = "append"
) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, query_id(batch.sparkSession, checkpoint_dir))

    return (
        lines.writeStream.outputMode(mode)
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


# ---- Counts per second -------------------------------------------------------------------------


def append_counts(
    lines: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    profile: Profile = PYTHON,
    ignore: Sequence[str] = (),
    tz: str = "UTC",
) -> StreamingQuery:
    """Start a query over all available input that commits the counts of every micro-batch to ``out_dir``.

    Several queries, one after the other or at the same time, may add to one folder.
    """

    def write_batch(batch: DataFrame, batch_id: int, query: str) -> None:
        parsed = parse.parse_lines(batch, profile, ignore, tz)
        commit_batch(aggregate.ops_per_second(parsed, profile), out_dir, query, batch_id)

    return _start(lines, checkpoint_dir, write_batch)


def read_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """``ops_per_second`` so far: the committed batches added up."""
    return aggregate.merge_files(committed(spark, out_dir, OPS))


# ---- Late lines --------------------------------------------------------------------------------


def ledger_counts(
    lines: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    delay: str,
    profile: Profile = PYTHON,
    ignore: Sequence[str] = (),
    tz: str = "UTC",
) -> StreamingQuery:
    """Start a query that counts lines in time and late lines apart, over all available input.

    The watermark of a batch is the latest event time of the query's committed batches before it, less
    ``delay`` (an interval as in SQL, ``"10 minutes"``). A line is late if its second ended at the
    watermark or before. The latest time is committed with the counts, so a restarted or repeated batch
    decides as the first time.
    """

    def write_batch(batch: DataFrame, batch_id: int, query: str) -> None:
        spark = batch.sparkSession
        before = manifest(spark, out_dir).where((F.col("query") == query) & (F.col("batch") < batch_id))
        parsed = parse.parse_lines(batch, profile, ignore, tz)
        mark = _watermark(before.agg(F.max("high")).first()[0], delay)
        epoch_second = F.floor(F.unix_micros("ts") / 1_000_000)
        cells = (
            parsed.withColumn("epoch_second", epoch_second)
            .groupBy("op_category", "second_key", "epoch_second")
            .agg(F.count("op_category").alias("n"), F.max(F.unix_micros("ts")).alias("high"))
            .where(F.col("n") > 0)
        )
        late = F.coalesce(_ended(mark), F.lit(False)).alias("late")
        counts = cells.select("op_category", "second_key", "epoch_second", late, "n", "high")
        commit_batch(counts, out_dir, query, batch_id)

    return _start(lines, checkpoint_dir, write_batch)


def _watermark(high: int | None, delay: str) -> Column:
    """Instant before which seconds are closed, null before the first batch."""
    return F.timestamp_micros(F.lit(high).cast("bigint")) - F.expr(f"INTERVAL {delay}")


def _ended(mark: Column) -> Column:
    return (F.col("epoch_second") + 1) * 1_000_000 <= F.unix_micros(mark)


def read_ledger(
    spark: SparkSession, out_dir: str, delay: str, profile: Profile = PYTHON
) -> DataFrame:
    """``(op_type, op_category, second, n_closed, n_open, n_late)``: every counted line is in one of them.

    Seconds are closed once the watermark of all committed batches has passed them: lines that still
    come for them are late. Late lines are shown where they belong, never dropped.
    """
    rows = committed(spark, out_dir, LEDGER.format(key=_key_type(profile)))
    high = manifest(spark, out_dir).groupBy("query").agg(F.max("high").alias("latest"))
    mark = F.timestamp_micros("latest") - F.expr(f"INTERVAL {delay}")
    closed, late = F.coalesce(_ended(mark), F.lit(False)), F.col("late")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    cells = (
        rows.join(high, "query", "left")
        .groupBy("op_category", "second_key")
        .agg(
            F.sum("n").alias("n"),
            total(~late & closed).alias("n_closed"),
            total(~late & ~closed).alias("n_open"),
            total(late).alias("n_late"),
        )
    )
    named = aggregate.finish_cells(cells, profile, ("n_closed", "n_open", "n_late"))
    return named.select("op_type", "op_category", "second", "n_closed", "n_open", "n_late")


# ---- Windows of the state store ----------------------------------------------------------------


def windowed_counts(
    lines: DataFrame,
    delay: str,
    profile: Profile = PYTHON,
    ignore: Sequence[str] = (),
    tz: str = "UTC",
) -> DataFrame:
    """Streaming counts in windows of one second of the event time; lines later than ``delay`` are dropped.

    The second key is part of the group, because plain lines name the second in their own offset.
    """
    parsed = parse.parse_lines(lines, profile, ignore, tz)
    return (
        parse.records(parsed)
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 second"), "op_category", "second_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def write_windowed(counts: DataFrame, out_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Start a query over all available input that commits changed windows per micro-batch."""

    def write_batch(batch: DataFrame, batch_id: int, query: str) -> None:
        changed = batch.select(F.col("window.start").alias("start"), "op_category", "second_key", "n")
        commit_batch(changed, out_dir, query, batch_id)

    return _start(counts, checkpoint_dir, write_batch, mode="update")


def read_windowed(spark: SparkSession, out_dir: str, profile: Profile = PYTHON) -> DataFrame:
    """``ops_per_second`` from the committed windows: within a query a window's count only grows, so the
    largest is its latest; different queries add up."""
    latest = (
        committed(spark, out_dir, WINDOWS.format(key=_key_type(profile)))
        .groupBy("query", "start", "op_category", "second_key")
        .agg(F.max("n").alias("n"))
    )
    cells = latest.groupBy("op_category", "second_key").agg(F.sum("n").alias("n"))
    return aggregate.finish_cells(cells, profile)
