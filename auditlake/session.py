"""Session settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "auditlake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs rely on; ``conf`` keys may use ``__`` for dots.

    * split size 512 MB: a text scan of 100 TB becomes about 200,000 tasks instead of 800,000;
    * AQE merges small shuffle partitions, so the shuffle partition count can stay high;
    * UTC session zone: rendered timestamps do not depend on the machine.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "512m",
        "spark.ui.showConsoleProgress": "false",
        # Generated methods above this size are never compiled by the JVM; run such a stage operator
        # by operator instead, which measured twice as fast.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Call-site capture per column expression only slows down building large plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables, from ``spark.checkpoint.dir``.

    A local-mode session (tests) gets a temporary folder when none is set; on a cluster a folder
    that only one machine sees would lose data, so there the setting is required.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="auditlake-"))
    return sc.getCheckpointDir()


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the file system that Spark's tables use, for other readers of it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:///", system.makeQualified(place).toString())


def materialize(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Compute ``df`` once, write it as a Parquet table in the shared folder, and read that.

    Used for the small aggregates that several report parts share. The lineage to the logs is cut: a
    lost executor costs a re-read of the table instead of another scan of the logs, and every part
    reads only its columns and its partitions. The tables stay below ``auditlake`` in the shared
    folder until the owner of that folder expires them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/auditlake/aggregate-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
