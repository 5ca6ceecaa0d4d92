"""Text log files as a table of lines with their place in the file.

A scan is strict: a file that breaks off while being read fails the job. Where broken files should be left
out instead, ``file_status`` opens every file in a task of its own beforehand and decodes compressed ones to
their end; ``read_lines`` with that status skips the files that have a reason, before any line of them is read.
So a file counts whole or not at all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import materialize

if TYPE_CHECKING:
    import pyarrow as pa

# Bits of monotonically_increasing_id() that number the rows of one partition.
ROW_BITS = 33


def file_name(path: Column) -> Column:
    """File URI as reports show it: decoded, and local files as plain paths."""
    # The URI decoder would read a plus sign as a space.
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(path.startswith("file:/"), F.regexp_replace(path, "^file:/+", "/")).otherwise(path)


def _plain(uri: str) -> str:
    return re.sub(r"^file:/+", "/", unquote(uri))


def _read_text(spark: SparkSession, path: str, skip_missing: bool) -> DataFrame | None:
    """Text reader over one argument; None if it names no file and that is allowed."""
    try:
        return spark.read.text(path)
    except AnalysisException as error:
        if skip_missing and error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    skip_missing: bool = False,
    status: DataFrame | None = None,
    partitions: Sequence[str] = (),
) -> DataFrame:
    """``(file, block_start, rid, line)`` of all files, in one parallel scan.

    A path listed twice is read twice. A path that names no file fails the call, or is left out with
    ``skip_missing``; ``file_list`` then still lists it. A file that breaks off while being read fails
    the job: half a file never enters a count. With the ``status`` of ``file_status``, files that have a
    reason there are not opened at all, and the others are read as strictly. Large files are split, so one file that
    holds most of the data is still read by many tasks; only compressed files are read whole.

    ``partitions`` names columns that the folder names give (``day=2025-08-05``); they come along, and a
    condition on them, applied to the lines before they are parsed, decides which folders are read.

    ``rid`` increases along the lines of a block; ``(file, block_start, rid)`` is the line order.
    These columns must be computed before any shuffle, which is why they are made here.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if skip_missing or status is not None:
        paths = [p for p in paths if _read_text(spark, p, True) is not None]
    if not paths:
        more = "".join(f", `{p}` string" for p in partitions)
        return spark.createDataFrame([], f"file string, block_start bigint, rid bigint, line string{more}")
    lines = spark.read.text(paths)
    broken = [] if status is None else _broken_files(status)
    if broken:
        # A condition on file names alone: Spark applies it to the list of files, so these are not opened.
        lines = lines.where(~file_name(F.col("_metadata.file_path")).isin(broken))
    return lines.select(
        file_name(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("rid"),
        F.col("value").alias("line"),
        *partitions,
    )


def with_line_position(lines: DataFrame) -> DataFrame:
    """Add ``pos``, the place of a line in its file, as one number of fixed width.

    The split start leads and the row number within the partition follows. A decimal holds both, and
    minimum over it still aggregates by hash, which a minimum over a struct would not.
    """
    row = F.col("rid").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).cast("decimal(10,0)")
    start = F.col("block_start").cast("decimal(18,0)") * F.lit(10**10).cast("decimal(11,0)")
    return lines.withColumn("pos", (start + row).cast("decimal(28,0)"))


def file_list(
    spark: SparkSession, paths: str | Sequence[str], skip_missing: bool = False
) -> DataFrame:
    """``(file, file_index)``: all files behind ``paths`` in argument order, named as in the lines.

    Spark itself resolves every argument, so relative paths, wildcards, ``{a,b}`` and ``..`` give the
    names that the scan gives. Files of a folder or wildcard are ordered by name. A path without files
    fails, or with ``skip_missing`` stays in the list, so that per-file reports show it with zeros.
    Only names are listed; no file is read.
    """
    ordered = dict.fromkeys(_named_files(spark, paths, skip_missing))
    rows = [(file, index) for index, file in enumerate(ordered)]
    return spark.createDataFrame(rows, "file string, file_index bigint")


def argument_list(
    spark: SparkSession, paths: str | Sequence[str], skip_missing: bool = False
) -> DataFrame:
    """``(file, position)``: the files of ``file_list``, those that are named twice twice."""
    rows = [(file, position) for position, file in enumerate(_named_files(spark, paths, skip_missing))]
    return spark.createDataFrame(rows, "file string, position bigint")


def _named_files(spark: SparkSession, paths: str | Sequence[str], skip_missing: bool) -> list[str]:
    named: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        lines = _read_text(spark, path, skip_missing)
        named += [_plain(path)] if lines is None else sorted({_plain(f) for f in lines.inputFiles()})
    return named


# ---- Whole files -------------------------------------------------------------------------------

# Broken files whose names a scan can leave out; more of them mean that the place itself is broken.
MAX_BROKEN = 10_000
STREAMED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
CHUNK = 4 << 20


def _broken_files(status: DataFrame) -> list[str]:
    names = [r.file for r in status.where(F.col("reason").isNotNull()).select("file").limit(MAX_BROKEN + 1).collect()]
    if len(names) > MAX_BROKEN:
        raise ValueError(f"more than {MAX_BROKEN} files cannot be read; see the file status")
    return names


def _read_whole(file: str) -> int:
    """Length of a file that can be read to its end; raises otherwise.

    Compressed files are decoded, as only their end shows whether they are whole. Of others the end is
    read: their length is known, and a scan reads them by ranges.
    """
    from pyarrow import fs

    store, path = (
        (fs.LocalFileSystem(), file) if file.startswith("/") else fs.FileSystem.from_uri(quote(file, safe=":/"))
    )
    found = store.get_file_info(path)
    if found.type != fs.FileType.File:
        raise FileNotFoundError("no such file")
    codec = next((c for end, c in STREAMED.items() if path.endswith(end)), None)
    if codec:
        with store.open_input_stream(path, compression=codec) as stream:
            while stream.read(CHUNK):
                pass
    elif path.endswith(".deflate"):
        inflate = zlib.decompressobj()
        with store.open_input_stream(path, compression=None) as stream:
            while part := stream.read(CHUNK):
                while part:
                    inflate.decompress(part, CHUNK)
                    part = inflate.unconsumed_tail
        if not inflate.eof:
            raise EOFError("compressed data ends too early")
    elif found.size:
        with store.open_input_file(path) as stream:
            stream.seek(found.size - 1)
            if len(stream.read(1)) != 1:
                raise EOFError("the file ends too early")
    return found.size


def file_status(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(file, file_index, length, reason)`` of all files behind ``paths``, in argument order.

    ``reason`` is null for files that can be read whole, else it says why not; ``length`` is null then. A path
    that names no file is such a row too. Every file is tried by one task, as many at a time as the
    cluster has cores, and in pieces of a few megabytes; the result is stored, so all that use it see the
    same decision. Formats that cannot be decoded piece by piece here (LZ4, Snappy) are only opened.
    """
    files = file_list(spark, paths, skip_missing=True)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            lengths, reasons = [], []
            for file in batch.column(0).to_pylist():
                try:
                    lengths.append(_read_whole(file))
                    reasons.append(None)
                except Exception as error:  # whatever a file system or a decoder says about the file
                    lengths.append(None)
                    reasons.append(f"{type(error).__name__}: {error}"[:500])
            arrays = [*batch.columns, pa.array(lengths, pa.int64()), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "file_index", "length", "reason"])

    tasks = max(1, min(files.count(), MAX_BROKEN))
    checked = files.repartition(tasks).mapInArrow(check, "file string, file_index bigint, length bigint, reason string")
    return materialize(checked)
