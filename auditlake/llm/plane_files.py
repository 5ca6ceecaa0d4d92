"""Token-id files as compressed bit or byte planes.

A file holds the documents of one range of identifiers in ascending order. Their ids are cut into
chunks of ``chunk_ids``; the 32-bit ids of a chunk are transposed into planes, four of bytes or 32 of
bits, so that the nearly constant high planes lie together, and every plane is compressed by itself
with zstandard; a plane of zeros is stored as length 0. The chunk index at the end of the file gives
the place, number of ids and plane lengths of each chunk, so that a reader fetches any chunk alone.

Layout, all numbers little-endian::

    b"IDPLANES" | chunk planes ... | document table | index | index length (u64) | b"IDPLANES"

The document table is one zstandard frame of (doc_id i64, ids u64) pairs. The index is JSON with
``planes``, ``chunk_ids``, ``chunks`` (``[offset, ids, [plane length, ...]]``), ``documents``,
``document_table`` (``[offset, length]``) and ``ids``.

Documents are dealt by range of the identifier, so files are ordered among each other and inside, a hot
source has no effect, and one task holds one range at a time. Files are written under a temporary name
and renamed, with the same content whenever a lost task runs again; the manifest that the write job
returns names the files of the successful tasks.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import give_back, materialize, text_or_empty
from auditlake.llm.tokenizer import corpus_encoder
from auditlake.session import shared_dir

MAGIC = b"IDPLANES"
CHUNK_IDS = 1 << 16
LEVEL = 3
# Bytes of text that are encoded at once: the more, the more of their words are equal.
TEXT_BYTES = 4 << 20


def to_planes(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """The planes of 32-bit ids, lowest first, compressed; an all-zero plane is empty."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bit":
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        rows = np.packbits(bits, axis=0, bitorder="little")
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    columns = np.ascontiguousarray(rows.T)
    return [compressor.compress(p.tobytes()) if p.any() else b"" for p in columns]


def from_planes(parts: list[bytes], count: int, planes: str = "byte") -> np.ndarray:
    """The ids of ``to_planes``."""
    size = (count + 7) // 8 if planes == "bit" else count
    decompressor = zstandard.ZstdDecompressor()
    rows = np.zeros((len(parts), size), dtype=np.uint8)
    for row, part in zip(rows, parts, strict=True):
        if part:
            row[:] = np.frombuffer(decompressor.decompress(part, max_output_size=size), dtype=np.uint8)
    columns = np.ascontiguousarray(rows.T)
    if planes == "bit":
        bits = np.unpackbits(columns, axis=0, bitorder="little", count=count)
        columns = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(columns).view("<u4").reshape(-1)


def file_bytes(
    docs: Iterator[tuple[int, bytes]], planes: str = "byte", chunk_ids: int = CHUNK_IDS
) -> tuple[Iterator[bytes], dict]:
    """The parts of a file in order, and the index, which is complete after the last part."""
    index: dict = {"planes": planes, "chunk_ids": chunk_ids, "chunks": [], "documents": 0, "ids": 0}

    def parts() -> Iterator[bytes]:
        yield MAGIC
        place, table, pending, held = len(MAGIC), [], [], 0

        def chunk(ids: np.ndarray) -> bytes:
            nonlocal place
            made = to_planes(ids, planes)
            index["chunks"].append([place, len(ids), [len(p) for p in made]])
            place += sum(map(len, made))
            return b"".join(made)

        for doc_id, packed in docs:
            ids = np.frombuffer(packed, dtype="<u4")
            table.append((doc_id, len(ids)))
            pending.append(ids)
            held += len(ids)
            if held >= chunk_ids:
                ids = np.concatenate(pending)
                for at in range(0, held - chunk_ids + 1, chunk_ids):
                    yield chunk(ids[at : at + chunk_ids])
                pending = [ids[held - held % chunk_ids :]]
                held %= chunk_ids
        if held:
            yield chunk(np.concatenate(pending))
        rows = zstandard.ZstdCompressor(level=LEVEL).compress(np.array(table, dtype="<i8").tobytes())
        index["document_table"] = [place, len(rows)]
        index["documents"], index["ids"] = len(table), int(sum(n for _, n in table))
        yield rows
        text = json.dumps(index).encode()
        yield text + len(text).to_bytes(8, "little") + MAGIC

    return parts(), index


def read_index(data: bytes) -> dict:
    """The index at the end of a file."""
    if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a complete id-plane file")
    end = len(data) - len(MAGIC) - 8
    size = int.from_bytes(data[end : end + 8], "little")
    return json.loads(data[end - size : end])


def read_documents(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """``(doc_id, ids)`` of a file in order, one chunk in memory at a time."""
    index = read_index(data)
    at, size = index["document_table"]
    raw = zstandard.ZstdDecompressor().decompress(
        data[at : at + size], max_output_size=16 * index["documents"] + 1
    )
    table = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)

    def chunks() -> Iterator[np.ndarray]:
        for place, count, sizes in index["chunks"]:
            ends = place + np.cumsum([0, *sizes])
            parts = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield from_planes(parts, count, index["planes"])

    stream, rest = chunks(), np.empty(0, dtype="<u4")
    for doc_id, count in table.tolist():
        parts, need = [], count
        while need > len(rest):
            parts.append(rest)
            need -= len(rest)
            rest = next(stream)
        parts.append(rest[:need])
        rest = rest[need:]
        yield doc_id, np.concatenate(parts)


def text_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into slices of at most ``limit`` bytes of text; a longer text is one by itself."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def write_id_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int | None = None,
    text: str = "text",
    id: str = "doc_id",
    kind: str = "word",
    planes: str = "byte",
    chunk_ids: int = CHUNK_IDS,
) -> DataFrame:
    """Write the ids of all documents in ascending order of ``id``; returns the manifest.

    The manifest has ``(part, file, documents, ids)`` per file and is itself a table in the shared
    folder. Null texts are empty and still get ``end_id``. Rows with the same identifier are all
    written, in the order of their texts; rows without one are refused. Other columns do not matter;
    an empty table gives an empty manifest.
    """
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encoder = corpus_encoder(tokenizer, kind)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        first = next(batches, None)
        while first is not None and first.num_rows == 0:
            first = next(batches, None)
        if first is None:
            return

        def packed() -> Iterator[tuple[int, bytes]]:
            batch = first
            while batch is not None:
                for part_of in text_slices(batch, 1, TEXT_BYTES):
                    ids = encoder.encode_texts(part_of.column(1))
                    yield from ((doc_id, i + end) for doc_id, i in zip(part_of.column(0).to_pylist(), ids, strict=True))
                batch = next(batches, None)
            give_back()

        parts, index = file_bytes(packed(), planes, chunk_ids)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{run}-{part:06d}.ids"
        temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            for piece in parts:
                out.write(piece)
        store.move(temporary, f"{root}/{name}")
        manifest = [[part], [f"{folder}/{name}"], [index["documents"]], [index["ids"]]]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(manifest, types, strict=True)],
            ["part", "file", "documents", "ids"],
        )

    known = F.coalesce(F.col(id), F.raise_error(F.lit("a row has no identifier")).cast("bigint"))
    rows = docs.select(known.cast("bigint").alias("id"), text_or_empty(text).alias("text"))
    _make_folder(docs.sparkSession, folder)
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return materialize(ordered.mapInArrow(write, "part int, file string, documents long, ids long"))


def read_id_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, ids)`` of the manifest's files; ``start`` counts all ids before a document.

    The starts of the files are a running sum over the manifest, one row per file; inside a file the
    reader counts on.
    """
    offsets = manifest.withColumn(
        "before", F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ).select(F.element_at(F.split("file", "/"), -1).alias("name"), F.coalesce("before", F.lit(0)).alias("before"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for before, data in zip(batch["before"].tolist(), batch["content"].tolist(), strict=True):
                start, held, size = before, [], 0
                for doc_id, ids in read_documents(bytes(data)):
                    held.append((doc_id, start, ids.astype("<u4").tobytes()))
                    start += len(ids)
                    size += len(ids)
                    if size > 1_000_000:
                        yield pd.DataFrame(held, columns=["doc_id", "start", "ids"])
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=["doc_id", "start", "ids"])

    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.ids")
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    )
    return files.join(F.broadcast(offsets), "name").select("before", "content").mapInPandas(
        read, "doc_id long, start long, ids binary"
    )


def _make_folder(spark: SparkSession, folder: str) -> None:
    """An empty folder, so that a table without rows, of which no task writes, can be read back."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one, named with the file system that Spark's tables use."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/auditlake/ids-{uuid.uuid4().hex}")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    full = system.makeQualified(folder).toString()
    return re.sub("^file:/+", "file:///", full)
