"""Exact top-k inner products with one KD-tree per shard.

Vectors are dealt evenly to shards by a hash of their identifier. Each shard builds a KD-tree: nodes are
split at the median of the component with the widest spread, and every node has the tight bounding box
of its own vectors. A query descends best-first: from a heap it takes the node with the largest
possible inner product with any point of the box, scores a leaf exactly, and stops when no box left can
reach the k-th score it already has.

That score travels: a query first searches the shard it lies in, and takes the k-th score found there
to all other shards, where it cuts off boxes from the start. Queries go to shards in blocks of bounded
size, so a task holds one tree and one block of queries. A vector that many rows share is spread over
all shards by the identifiers.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import materialize

SCALE = 256
SHARD_ROWS, BLOCK_QUERIES, LEAF = 16_384, 4_096, 128


def scaled(column: str, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component; null if the vector, or one component, is not finite."""
    finite = F.forall(
        column,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    return F.when(finite, F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Tree:
    """A KD-tree over the rows of ``points``."""

    FIELDS = ("ids", "points", "low", "high", "begin", "end", "left")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(ids))
        low, high, begin, end, left = [], [], [], [], []

        def node(a: int, b: int) -> int:
            box = points[order[a:b]]
            low.append(box.min(axis=0))
            high.append(box.max(axis=0))
            begin.append(a)
            end.append(b)
            left.append(-1)
            return len(left) - 1

        todo = [node(0, len(ids))] if len(ids) else []
        while todo:
            at = todo.pop()
            a, b = begin[at], end[at]
            spread = high[at] - low[at]
            if b - a <= leaf or not spread.any():
                continue
            axis, middle = int(spread.argmax()), (a + b) // 2
            order[a:b] = order[a:b][np.argpartition(points[order[a:b], axis], middle - a)]
            left[at] = node(a, middle)
            todo += [left[at], node(middle, b)]
        width = points.shape[1]
        return cls(
            ids=ids[order],
            points=points[order],
            low=np.array(low, dtype=np.int64).reshape(-1, width),
            high=np.array(high, dtype=np.int64).reshape(-1, width),
            begin=np.array(begin, dtype=np.int64),
            end=np.array(end, dtype=np.int64),
            left=np.array(left, dtype=np.int64),
        )

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as arrays:
            return cls(**{name: arrays[name] for name in cls.FIELDS})

    def search(
        self, queries: np.ndarray, own: np.ndarray, k: int, known: np.ndarray | None = None
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(ids, scores)`` of the best ``k`` rows per query, without rows of the query's own id.

        ``known`` are scores that k rows elsewhere reach already (the least number if none): rows
        below cannot matter and may be left out.
        """
        floor = np.iinfo(np.int64).min
        if not len(self.ids):
            return [(self.ids, self.ids)] * len(queries)
        width = max(queries.shape[1], self.points.shape[1])
        points, low, high = (_padded(x, width) for x in (self.points, self.low, self.high))
        queries = _padded(queries, width)
        # Whole numbers below 2**53 in all sums: floating point is exact there, and uses fast kernels.
        largest = [max(1, int(np.abs(x).max(initial=0))) for x in (queries, points)]
        if largest[0] * largest[1] * width < 2**53:
            points, low, high, queries = (x.astype(np.float64) for x in (points, low, high, queries))
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        found = []
        for row, query in enumerate(queries):
            least = floor if known is None else int(known[row])
            ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
            heap = [(-bounds[row, 0], 0)]
            while heap:
                bound, at = heapq.heappop(heap)
                if -bound < least:
                    break
                if self.left[at] >= 0:
                    for child in (self.left[at], self.left[at] + 1):
                        if bounds[row, child] >= least:
                            heapq.heappush(heap, (-bounds[row, child], int(child)))
                    continue
                mine = slice(self.begin[at], self.end[at])
                reached = points[mine] @ query
                good = np.flatnonzero((reached >= least) & (self.ids[mine] != own[row]))
                if not len(good):
                    continue
                ids = np.concatenate([ids, self.ids[mine][good]])
                scores = np.concatenate([scores, reached[good].astype(np.int64)])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    least = max(least, int(scores[-1]))
            found.append((ids, scores))
        return found


def _padded(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column; shorter ones count as having zeros at the end."""
    lists = lists.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _rows(query_ids: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    counts = [len(ids) for ids, _ in found]
    columns = [
        np.repeat(query_ids, counts),
        *(np.concatenate([f[n] for f in found] or [np.empty(0, np.int64)]) for n in (0, 1)),
    ]
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], schema=RESULT)


def top_k(
    vectors: DataFrame,
    k: int = 5,
    query_every: int = 50,
    id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of every query.

    Queries are the rows whose identifier ``query_every`` divides, against all rows of another
    identifier; ties go to the smaller identifier. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without identifier. Rows that repeat an identifier are all
    candidates, and as queries one of them (the least vector) counts. Shorter vectors count as having
    zeros at the end. Sums must fit 64 bits. Other columns do not matter; an empty table gives no rows.
    """
    rows = (
        vectors.select(F.col(id).cast("long").alias("id"), scaled(vector, scale).alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
    )
    rows = materialize(rows)
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))
    home = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")

    def build(table: pa.Table) -> pa.Table:
        tree = Tree.build(table["id"].to_numpy(), _matrix(table["v"]))
        return pa.table({"shard": table["shard"].slice(0, 1), "tree": pa.array([tree.to_bytes()], pa.binary())})

    trees = materialize(
        rows.withColumn("shard", home).groupBy("shard").applyInArrow(build, "shard int, tree binary")
    )
    queries = (
        rows.where(F.col("id") % query_every == 0)
        .groupBy("id")
        .agg(F.min("v").alias("v"))
        .withColumn("home", home)
    )

    def search(trees: pa.Table, queries: pa.Table) -> pa.Table:
        if not trees.num_rows or not queries.num_rows:
            return RESULT.empty_table()
        ids = queries["id"].to_numpy()
        known = queries["known"].to_numpy() if "known" in queries.column_names else None
        tree = Tree.from_bytes(trees["tree"][0].as_py())
        return _rows(ids, tree.search(_matrix(queries["v"]), ids, k, known))

    schema = "query_id long, vec_id long, score long"
    first = materialize(
        trees.groupBy("shard").cogroup(queries.withColumnRenamed("home", "shard").groupBy("shard")).applyInArrow(search, schema)
    )
    if shards == 1:
        found = first
    else:
        # The k-th score at home; with fewer than k rows there, nothing is known yet.
        kth = first.groupBy("query_id").agg(
            F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth")
        )
        known = F.coalesce("kth", F.lit(-(1 << 63))).alias("known")
        blocks = max(1, -(-total // query_every // BLOCK_QUERIES))
        block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
        away = (
            queries.join(kth.withColumnRenamed("query_id", "id"), "id", "left")
            .select("id", "v", "home", known, block, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
            .where(F.col("shard") != F.col("home"))
            .drop("home")
        )
        trees_by_block = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        others = (
            trees_by_block.groupBy("shard", "block")
            .cogroup(away.groupBy("shard", "block"))
            .applyInArrow(search, schema)
        )
        found = first.unionByName(others)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
