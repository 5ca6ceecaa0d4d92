"""Packing documents into sequences by bin completion.

Only the number of pieces of each length decides how well they pack, and a capacity of ``C`` tokens
has ``C`` lengths. So Spark counts pieces by length, the search runs on that table of at most ``C``
numbers whatever the size of the corpus, and Spark deals the pieces to the places found.

The search is branch and bound over bins around the largest length left. A node enumerates undominated
fillings of what that length leaves: one length that fits exactly dominates all else, then exact pairs
and triples, then the fillings of least waste. A filling is used as many times as the counts allow, so a
solution is a short list of fillings with repeats. The incumbent is best-fit decreasing on the table;
a branch is cut when its waste so far proves that it cannot use fewer bins than the incumbent. The
search ends when a solution meets the lower bound or after ``nodes`` nodes, which bounds its time and
never the corpus; it returns the best solution seen.

Dealing: the pieces of a length are numbered by a sum over a small table of counts per (length, bucket)
and a row number inside the bucket. A length that a third of all pieces have is split over the buckets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import give_back, in_slices, materialize, text_or_empty
from auditlake.llm.tokenizer import corpus_encoder

CAPACITY = 1024
NODES = 5_000
BUCKETS, ROWS_A_BUCKET = 64, 100_000
Filling = tuple[tuple[int, ...], int]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = CAPACITY,
    text: str = "text",
    id: str = "doc_id",
    kind: str = "byte",
    release: bool = False,
) -> DataFrame:
    """``(id, piece, start, length, ids)``: documents as ids with ``end_id``, cut where too long.

    Only documents of more than ``capacity`` ids are cut, into pieces of exactly ``capacity`` but the
    first, which has the rest. ``ids`` are packed little-endian unsigned 32-bit integers. Null texts
    are empty and give one piece with the end id; every row gives its pieces, also repeated rows and
    rows without identifier. ``release`` gives the tables of the tokenizer back after every task, for
    workers that have other work to do afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = corpus_encoder(tokenizer, kind), struct.pack("<I", end_id)
        for batch in in_slices(batches):
            which, piece, start, ids = [], [], [], []
            for row, packed in enumerate(encoder.encode_texts(batch.column(1))):
                packed += end
                size = len(packed) // 4
                cuts = [0, *range(size % capacity or capacity, size, capacity), size]
                for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    which.append(row)
                    piece.append(n)
                    start.append(a)
                    ids.append(packed[4 * a : 4 * b])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(which, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array([len(p) // 4 for p in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["id", "piece", "start", "length", "ids"],
            )
        if release:
            del encoder
            corpus_encoder.cache_clear()
            give_back()

    id_type = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(
        run, f"id {id_type}, piece int, start long, length long, ids binary"
    ).withColumnRenamed("id", id)


def _repeats(filling: tuple[int, ...], counts: np.ndarray) -> int:
    lengths, uses = np.unique(list(filling), return_counts=True)
    return int((counts[lengths] // uses).min())


def _exact_pairs(rest: int, counts: np.ndarray, limit: int) -> list[tuple[int, ...]]:
    """Pairs that fill ``rest``, those with the largest length first."""
    small = np.arange(1, rest // 2 + 1)
    there = (counts[small] > 0) & (counts[rest - small] > 0)
    there &= (small * 2 != rest) | (counts[small] > 1)
    return [(int(rest - x), int(x)) for x in small[there][:limit]]


def fillings(rest: int, counts: np.ndarray, limit: int = 6) -> list[tuple[int, ...]]:
    """Undominated fillings of ``rest``, least waste first; at most ``limit`` of them."""
    if rest == 0:
        return [()]
    if counts[rest]:
        return [(rest,)]
    found = _exact_pairs(rest, counts, limit)
    lengths = np.flatnonzero(counts[: rest + 1])[::-1]
    for largest in lengths[:64].tolist():
        if len(found) >= limit:
            return found
        counts[largest] -= 1
        found += [
            (largest, *pair)
            for pair in _exact_pairs(rest - largest, counts, limit - len(found))
            if pair[0] <= largest
        ]
        counts[largest] += 1
    if not found:
        # No exact filling of up to three: the best fit, then the rest of it in the same way.
        for largest in lengths[:limit].tolist():
            counts[largest] -= 1
            deeper = fillings(rest - largest, counts, 1)
            counts[largest] += 1
            found.append((largest, *deeper[0]))
        found = sorted(set(found), key=lambda f: (rest - sum(f), len(f)))
    return found or [()]


def best_fit(counts: np.ndarray, capacity: int) -> list[Filling]:
    """The incumbent: fill up the largest length with the longest that still fits, again and again."""
    counts, solution = counts.copy(), []
    while counts.any():
        left, filling = capacity, []
        while left > 0 and (fits := np.flatnonzero(counts[: left + 1])).size:
            length = int(fits[-1])
            filling.append(length)
            counts[length] -= 1
            left -= length
        np.add.at(counts, list(filling), 1)
        times = _repeats(tuple(filling), counts)
        np.subtract.at(counts, list(filling), times)
        solution.append((tuple(filling), times))
    return solution


def bins_of(solution: list[Filling]) -> int:
    return sum(times for _, times in solution)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins.

    For every ``a`` up to half the capacity: lengths above ``capacity - a`` fill a bin alone, no two
    above the half share one, and lengths from ``a`` to the half need what those bins cannot take.
    """
    lengths = np.arange(len(counts))
    number = np.concatenate([[0], np.cumsum(counts)])
    volume = np.concatenate([[0], np.cumsum(counts * lengths)])
    half = capacity // 2
    a = np.arange(0, half + 1)
    alone = number[-1] - number[capacity - a + 1]
    large = number[capacity - a + 1] - number[half + 1]
    room = large * capacity - (volume[capacity - a + 1] - volume[half + 1])
    rest = volume[half + 1] - volume[a] - room
    return int((alone + large + np.maximum(0, -(-rest // capacity))).max())


def pack_lengths(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[Filling]:
    """Fillings with repeats that use up ``counts`` (index: length) in as few bins as found."""
    counts = np.array(counts, dtype=np.int64)
    best = best_fit(counts, capacity)
    fewest, least = bins_of(best), lower_bound(counts, capacity)
    if fewest <= least:
        return best
    lengths = np.arange(len(counts))
    total = int((counts * lengths).sum())
    # Depth-first over (counts left, fillings so far); the last of a stack entry's choices comes first.
    stack = [(counts, [], 0)]
    while stack and nodes > 0 and fewest > least:
        left, solution, used = stack.pop()
        nodes -= 1
        while True:
            open_lengths = np.flatnonzero(left)
            if not open_lengths.size:
                if used < fewest:
                    fewest, best = used, solution
                break
            filled = total - int((left * lengths).sum())
            wasted = used * capacity - filled
            # Even with no more waste the bins would not be fewer than the incumbent's.
            if -(-(total + wasted) // capacity) >= fewest:
                break
            largest = int(open_lengths[-1])
            left = left.copy()
            left[largest] -= 1
            choices = fillings(capacity - largest, left)
            left[largest] += 1
            options = []
            for choice in choices:
                filling = (largest, *choice)
                times = _repeats(filling, left)
                after = left.copy()
                np.subtract.at(after, list(filling), times)
                options.append((after, [*solution, (filling, times)], used + times))
            stack += options[:0:-1]
            left, solution, used = options[0]
    return best


def assign(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces with ``length``; ``keys`` order them.

    The table is read several times, so it should be stored. Any other columns stay. Sequences are
    numbered from 0 and are gapless from offset 0; an empty table gives no rows.
    """
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in counted:
        counts[row["length"]] = row["n"]
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    taken = np.zeros(capacity + 1, dtype=np.int64)
    for filling, times in pack_lengths(counts, capacity, nodes):
        offset = 0
        for length in dict.fromkeys(filling):
            uses = filling.count(length)
            places.setdefault(length, []).append((int(taken[length]), first, uses, offset))
            taken[length] += uses * times
            offset += uses * length
        first += times
    tables = {length: np.array(rows, dtype=np.int64) for length, rows in places.items()}

    buckets = max(BUCKETS, int(counts.sum()) // ROWS_A_BUCKET)
    kept = pieces.columns
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sums = (
        dealt.groupBy("length", "_bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "_before",
            F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("length", "_bucket").orderBy(*keys)
    numbered = (
        dealt.withColumn("_row", F.row_number().over(inside) - 1)
        .join(sums, ["length", "_bucket"])
        .select(*kept, (F.col("_before") + F.col("_row")).cast("long").alias("_rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(kept.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(len(kept)).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for size in np.unique(length).tolist():
                mine = np.flatnonzero(length == size)
                table = tables[size]
                rows = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                turn, copy = np.divmod(rank[mine] - rows[:, 0], rows[:, 2])
                sequence[mine] = rows[:, 1] + turn
                offset[mine] = rows[:, 3] + copy * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = CAPACITY,
    text: str = "text",
    id: str = "doc_id",
    with_ids: bool = True,
    release: bool = False,
) -> DataFrame:
    """Pack all documents: ``(id, piece, start, length, ids_crc32, sequence_id, offset[, ids])``.

    The pieces are stored once in the shared folder, so that nothing is tokenized twice; ``with_ids``
    keeps their ids, else only the checksum of the packed ids.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity, text, id, release=release)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    stored = materialize(pieces if with_ids else pieces.drop("ids"))
    return assign(stored, [id, "piece", "start", "ids_crc32"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the token ids of every sequence, from ``pack`` with ids."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.aggregate("parts", F.lit(b""), lambda all, p: F.concat(all, p["ids"])).alias("ids"))
    )
