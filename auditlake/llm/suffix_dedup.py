"""Removal of byte strings that occur more than once, by interval expansion on a Burrows-Wheeler transform.

A byte goes when a string of ``width`` bytes that covers it also starts somewhere else in the corpus, in
the same text or another. All strings are judged on the input.

**Bringing equal strings together.** A window of ``width`` bytes belongs to one *segment*, chosen by
content (``anchors.segments``), so equal windows lie in segments of equal anchor. Spark counts anchors
(combined before the shuffle) and only segments whose anchor occurs again go on, about a third of a
corpus with many copies. Segments of equal bytes are repeated as a whole; of each distinct segment one
representative goes on, and only where its anchor has another distinct segment.

**Inside a block.** Representatives are dealt by anchor and joined to blocks of bounded size. A block is
suffix-sorted, and its transform is expanded breadth-first: boundaries between neighbouring suffixes get
their common prefix length in increasing order, a boundary of length l giving those of length l + 1 by
backward extension with every character, and the expansion stops at ``width``. Boundaries without a
value then join suffixes that agree in ``width`` bytes: repeated windows.

**Hot anchors.** An anchor with more than ``GROUP`` distinct segments (a passage in a third of all texts,
each time in other surroundings) is never gathered: its segments are dealt to groups of about that size,
which are expanded one by one. What a group leaves open, the windows it does not repeat and one of each
kind it does, is counted across groups by a 128-bit hash, combined before the shuffle. This is linear in
the number of segments, and exact.

The result flows back over (anchor, segment) to all occurrences; joins whose one side may be hot have
plain exchanges on both sides, so Spark splits them. Intermediate tables lie in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.anchors import Rolling, segments
from auditlake.llm.common import batch_bytes, in_slices, materialize, release, text_or_empty, texts_of

WIDTH, GRAM = 200, 64
# Distinct segments of one anchor that are expanded together; anchors with more are dealt to groups.
GROUP = 48
BLOCK_BYTES = 1 << 16
# Spans are merged within parts of a text of so many bytes before they are gathered.
SPAN_PART = 4096
NO_ID = -(1 << 63)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``symbols`` in the order of what follows them, up to ``depth`` symbols."""
    size = len(symbols)
    bits = max(1, int(symbols.max(initial=1)).bit_length())
    take = 63 // bits
    padded = np.concatenate([symbols, np.zeros(take, dtype=symbols.dtype)]).astype(np.int64)
    key = np.zeros(size, dtype=np.int64)
    for n in range(take):
        key = (key << bits) | padded[n : n + size]
    reach = take
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        if reach >= depth or rank[order[-1]] == size:
            return order
        after = np.zeros(size, dtype=np.int64)
        after[: max(0, size - reach)] = rank[reach:]
        key = rank * (size + 1) + after
        reach *= 2


def repeated_places(symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which places begin a string of ``width`` symbols that begins elsewhere too, and which places
    stand for the rest: one of each group of equal strings.

    Symbol 0 separates strings and matches nothing, itself included.
    """
    symbols = np.append(symbols, symbols.dtype.type(0))
    size = len(symbols)
    found = np.zeros(size, dtype=bool)
    order = suffix_order(symbols, width + 1)
    transform = symbols[order - 1]
    present, which, counts = np.unique(transform, return_inverse=True, return_counts=True)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    # to[j][c]: the boundary that backward extension with character c makes of boundary j, which is the
    # bucket of c plus how often c stands in the transform before j. One row of a boundary is one piece of
    # memory. Extensions that leave the bucket hit the next one's first boundary, which is never open.
    chars = len(present) - int(present[0] == 0)
    to = np.zeros((size + 1, chars), dtype=np.int32)
    column = which - (len(present) - chars)
    to[0] = first[len(present) - chars : -1]
    rows = np.flatnonzero(column >= 0)
    to[rows + 1, column[rows]] = 1
    np.cumsum(to, axis=0, out=to)
    open_boundary = np.ones(size + 1, dtype=bool)
    open_boundary[size] = False
    seen_at = np.empty(size + 1, dtype=np.int64)
    # Length 0: where another first character begins, and everywhere among the separators.
    fresh = np.concatenate([np.arange(first[1], dtype=np.int32), first[1:-1]])
    open_boundary[fresh] = False
    for _ in range(width - 1):
        if not len(fresh):
            break
        longer = to[fresh].ravel()
        longer = longer[open_boundary[longer]]
        open_boundary[longer] = False
        # Each once: the last mention of a boundary counts.
        mention = np.arange(len(longer))
        seen_at[longer] = mention
        fresh = longer[seen_at[longer] == mention]
    same = np.flatnonzero(open_boundary[:size])
    found[order[same]] = True
    found[order[same - 1]] = True
    heads = found.copy()
    heads[order[same]] = False
    return found[:-1], heads[:-1]


def _runs(flags: np.ndarray) -> np.ndarray:
    """``(begin, end)`` of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges.reshape(-1, 2)


def _segments(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``(key, content, doc, tid, start, windows)``: all segments of all texts."""
    schema = "key long, content long, doc long, tid long, start long, windows long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            doc, tid = (batch.column(n).to_numpy(zero_copy_only=False) for n in (0, 1))
            data, ends = batch_bytes(texts_of(batch.column(2)))
            for start, windows, key, content in segments(data, ends, width, gram):
                row = np.searchsorted(ends, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key, content, doc[row], tid[row], start - ends[row], windows)],
                    ["key", "content", "doc", "tid", "start", "windows"],
                )

    return docs.select("doc", "tid", "text").mapInArrow(run, schema)


def _bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(key, content, parts, segment)``: the bytes of segments, cut out of their texts."""
    by_text = wanted.groupBy("doc", "tid").agg(
        F.collect_list(F.struct("start", "length", "key", "content", "parts")).alias("cuts")
    )
    # Rows that repeat a text under its identifier give the same segments again.
    joined = docs.dropDuplicates(["doc", "tid"]).join(by_text, ["doc", "tid"]).select("text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            out: list[list] = [[], [], [], []]
            for text, cuts in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for cut in cuts:
                    out[0].append(cut["key"])
                    out[1].append(cut["content"])
                    out[2].append(cut["parts"])
                    out[3].append(raw[cut["start"] : cut["start"] + cut["length"]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())],
                ["key", "content", "parts", "segment"],
            )

    return joined.mapInArrow(run, "key long, content long, parts int, segment binary")


RUNS, SPANS = "array<struct<begin:int,end:int>>", "array<struct<begin:bigint,end:bigint>>"


def _by_blocks(reps: DataFrame, width: int, by: tuple[str, ...]) -> DataFrame:
    """``(key, content, runs, at, open)``: repeated windows of segments, in blocks of whole ``by`` groups.

    ``open`` are hashes of the windows at places ``at`` that a block beyond could repeat: those that its
    group does not repeat, and one of each kind that it does. They are given for groups of hot anchors.
    """
    runs_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    names = ["key", "content", "runs", "at", "open"]
    types = [pa.int64(), pa.int64(), runs_type, pa.list_(pa.int32()), pa.list_(pa.binary())]

    def expand(rows: list[tuple]) -> pa.RecordBatch:
        parts, places, at = [], [], 0
        for *_, segment in rows:
            parts += [np.frombuffer(segment, dtype=np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)]
            places.append(at)
            at += len(segment) + 1
        flags, heads = repeated_places(np.concatenate(parts), width)
        out: list[list] = [[], [], [], [], []]
        for place, (*_, key, content, hot, segment) in zip(places, rows, strict=True):
            windows = slice(place, place + len(segment) - width + 1)
            mine = [{"begin": a, "end": b} for a, b in _runs(flags[windows]).tolist()]
            rest = np.flatnonzero(~flags[windows] | heads[windows]).tolist() if hot else []
            if mine or rest:
                hashes = [hashlib.blake2b(segment[n : n + width], digest_size=16).digest() for n in rest]
                for column, value in zip(out, (key, content, mine, rest, hashes), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # A block ends only between groups.
                if size > BLOCK_BYTES and row[: len(by)] != held[-1][: len(by)]:
                    yield expand(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1]) + 1
        if held:
            yield expand(held)

    groups = [F.col(c).alias(f"group{n}") for n, c in enumerate(by)]
    rows = reps.select(*groups, "key", "content", "hot", "segment")
    order = [f"group{n}" for n in range(len(by))]
    ordered = rows.repartition(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, f"key long, content long, runs {RUNS}, at array<int>, open array<binary>")


def _hot_anchors(reps: DataFrame, width: int) -> DataFrame:
    """``(key, content, runs)`` for anchors with many segments.

    Their segments are dealt to groups of bounded size by content. Each group is expanded by itself; what
    repeats across groups is found by counting the open windows.
    """
    blocks = materialize(
        _by_blocks(
            reps.withColumn("part", F.pmod(F.xxhash64("content"), F.col("parts"))), width, ("key", "part")
        )
    )
    opened = blocks.select("key", "content", F.explode(F.arrays_zip("at", "open")).alias("w")).select(
        "key", "content", F.col("w.at").alias("at"), F.col("w.open").alias("window")
    )
    repeated = materialize(
        opened.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("window")
    )
    across = (
        opened.join(repeated, "window", "left_semi")
        .groupBy("key", "content")
        .agg(F.collect_list(F.struct(F.col("at").alias("begin"), (F.col("at") + 1).alias("end"))).alias("runs"))
    )
    inside = blocks.where(F.size("runs") > 0).select("key", "content", "runs")
    return inside.unionByName(across.select("key", "content", F.col("runs").cast(RUNS)))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``(doc, tid, spans)`` of texts with repeated windows; ``docs`` has ``doc``, ``tid``, ``text``.

    ``spans`` are ``(begin, end)`` in bytes of the text, in any order and possibly overlapping.
    """
    found = _segments(docs, width, gram)
    again = materialize(
        found.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
        .where(F.col("n") > 1)
        .select("key", (F.col("low") != F.col("high")).alias("mixed"))
    )
    candidates = materialize(found.join(again, "key"))
    release(docs.sparkSession)
    distinct = materialize(
        candidates.groupBy("key", "content")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("doc", "tid", "start", "windows")).alias("at"),
            F.first("mixed").alias("mixed"),
        )
        .select("key", "content", "n", "at.*", "mixed")
    )
    number = F.count(F.lit(1))
    per_key = materialize(
        distinct.where("mixed")
        .groupBy("key")
        .agg(F.ceil(number / GROUP).cast("int").alias("parts"))
    )
    # A segment that is repeated as a whole is settled; it goes on only as a partner for others.
    wanted = (
        distinct.where("mixed")
        .join(per_key, "key")
        .select("key", "content", "parts", "doc", "tid", "start", (F.col("windows") + width - 1).alias("length"))
    )
    reps = materialize(_bytes_of(docs, wanted)).withColumn("hot", F.col("parts") > 1)
    release(docs.sparkSession)
    few = _by_blocks(reps.where(~F.col("hot")), width, ("key",)).select("key", "content", "runs")
    partial = few.unionByName(_hot_anchors(reps.where("hot"), width))
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("windows").cast("int").alias("end"))).cast(RUNS)
    full = distinct.where(F.col("n") > 1).select("key", "content", whole.alias("runs"))
    marks = materialize(full.unionByName(partial))
    release(docs.sparkSession)
    runs = candidates.join(marks, ["key", "content"]).select("doc", "tid", "start", F.explode("runs").alias("run"))
    return _gathered(
        runs.select(
            "doc",
            "tid",
            (F.col("start") + F.col("run.begin")).alias("begin"),
            (F.col("start") + F.col("run.end") + (width - 1)).alias("end"),
        )
    )


def _gathered(spans: DataFrame) -> DataFrame:
    """``(doc, tid, spans)`` from single spans: cut at the edges of parts of a text, merged part by part.

    A text whose every window repeats has a span for each byte, and each row that repeats a text has
    them again. Equal spans of a part combine before the exchange; merged, a part holds few, as spans are
    long, so what is gathered for a text is a small share of its bytes.
    """
    cut = spans.withColumn(
        "part", F.explode(F.expr(f"sequence(begin div {SPAN_PART}, (end - 1) div {SPAN_PART})"))
    ).select(
        "doc",
        "tid",
        "part",
        F.greatest("begin", F.col("part") * SPAN_PART).alias("begin"),
        F.least("end", (F.col("part") + 1) * SPAN_PART).alias("end"),
    )

    def add(merged: Column, span: Column) -> Column:
        last = F.try_element_at(merged, F.lit(-1))
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        touching = F.concat(F.slice(merged, 1, F.size(merged) - 1), F.array(longer)).cast(SPANS)
        return F.when(span["begin"] <= last["end"], touching).otherwise(
            F.concat(merged, F.array(span)).cast(SPANS)
        )

    parts = cut.groupBy("doc", "tid", "part").agg(
        F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("found")
    )
    merged = parts.select("doc", "tid", F.aggregate("found", F.array().cast(SPANS), add).alias("spans"))
    return merged.groupBy("doc", "tid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merge_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    merged: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([begin, end])
    return [(a, b) for a, b in merged]


def _prepared(docs: DataFrame, text: str, id: str) -> DataFrame:
    """Identifier and text as the spans know them, with the text's hash to tell equal identifiers apart."""
    return docs.withColumns(
        {
            "__dedup_doc": F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)),
            "__dedup_tid": F.xxhash64(text_or_empty(text)),
            "__dedup_text": text_or_empty(text),
        }
    )


def _with_spans(docs: DataFrame, keep: list[str], width: int, gram: int, text: str, id: str) -> DataFrame:
    """Columns ``keep`` of every row of ``docs``, then its text, never null, and its spans or null."""
    rows = _prepared(docs, text, id)
    names = {"doc": "__dedup_doc", "tid": "__dedup_tid", "text": "__dedup_text"}
    plain = rows.select(*[F.col(name).alias(short) for short, name in names.items()])
    spans = repeated_spans(plain, width, gram).select(
        F.col("doc").alias("__dedup_doc"), F.col("tid").alias("__dedup_tid"), F.col("spans").alias("__dedup_spans")
    )
    joined = rows.join(spans, ["__dedup_doc", "__dedup_tid"], "left")
    return joined.select(*keep, "__dedup_text", "__dedup_spans")


def suffix_dedup(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """Add ``kept`` (binary), ``spans`` (merged, in bytes) and ``n_bytes`` to every row of ``docs``.

    Null texts are empty. Texts shorter than ``width`` bytes keep all. Repeated rows are occurrences
    like any other, so a row of ``width`` or more bytes that is there twice loses all of it in both.
    Rows without identifier are treated by their texts. Existing columns of the three names are
    replaced; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("kept", "spans", "n_bytes")]
    joined = _with_spans(docs, keep, width, gram, text, id)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in in_slices(batches):
            kept, merged, sizes = [], [], []
            for value, found in zip(
                texts_of(batch.column(len(keep))), batch.column(len(keep) + 1).to_pylist(), strict=True
            ):
                raw = value.encode("utf-8", "surrogatepass")
                gone = merge_spans(found or [])
                edges = [0, *[x for span in gone for x in span], len(raw)]
                kept.append(b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
                merged.append([{"begin": a, "end": b} for a, b in gone])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(kept, pa.binary()), pa.array(merged, kind), pa.array(sizes, pa.int64())],
                [*keep, "kept", "spans", "n_bytes"],
            )

    return joined.mapInArrow(run, f"{fields}, kept binary, spans {SPANS}, n_bytes long")


def drop_passages(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """``docs`` with what ``suffix_dedup`` keeps as the text, all other columns as they are.

    Characters that a repeated passage covers only in part stay, so a text is whole characters. A null
    text becomes an empty one.
    """
    columns = docs.columns
    at = columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = zip(texts_of(batch.column(len(columns))), batch.column(len(columns) + 1).to_pylist(), strict=True)
            texts = [
                whole_characters(value, [{"begin": a, "end": b} for a, b in merge_spans(gone)]) if gone else value
                for value, gone in found
            ]
            arrays = list(batch.columns[: len(columns)])
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return _with_spans(docs, columns, width, gram, text, id).mapInArrow(run, fields)


def whole_characters(text: str, spans: list[dict]) -> str:
    """The text without the spans; a character that a span covers in part stays."""
    raw = text.encode("utf-8", "surrogatepass")
    kept, at = [], 0
    for span in spans:
        begin, end = span["begin"], span["end"]
        # Bytes 10xxxxxx continue a character.
        while begin < end and raw[begin] & 0xC0 == 0x80:
            begin += 1
        while end > begin and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        kept.append(raw[at:begin])
        at = end
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")
