"""Hard negatives from a multiway hyperplane tree with distance ranges between siblings.

Vectors are dealt evenly to shards, and every shard builds one tree. A node picks a few of its rows that
lie far apart as split points; every row goes to its nearest split point (so cells are bounded by
hyperplanes), and for each pair of siblings the node stores the least and largest distance from the one
split point to the rows of the other's subtree. A query measures its distance ``d`` to all split points of
a node. By the triangle inequality a subtree with the range ``[a, b]`` as seen from a split point lies
between ``max(d - b, a - d)`` and ``d + b`` from the query; the ranges of all split points are intersected,
and a sibling whose interval misses the annulus of every window is eliminated. Leaves are scored exactly.

Inner products become distances by one more component: with ``M`` the largest norm of a tree's rows, a row
``x`` is extended by ``sqrt(M**2 - |x|**2)`` and a query by 0, so that
``distance**2 = |q|**2 + M**2 - 2 * score``. A window of scores then is an annulus around the query. The
bounds are floating point with a safe margin; scores are whole numbers.

Mining takes two searches: the best rows of the anchor's own label, without a window, and for every such
positive the best rows of other labels within its window of scores. In both, an anchor first searches the
shard it lies in, and takes the k-th score found there to the other shards. A subtree whose rows all have
one label is skipped where that label is not wanted. Tasks hold one tree and one block of anchors.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import materialize
from auditlake.llm.kd_search import SCALE, _matrix, _padded, scaled

SHARD_ROWS, BLOCK_ANCHORS = 16_384, 2_048
LEAF, FANOUT, TRIED = 64, 12, 96
# Below and above every score; small enough to be doubled and squared without harm.
LEAST, MOST = -(1 << 60), 1 << 60
NOT_SCORED = LEAST - 1
MIXED = -1
MARGIN = 1e-6
# Leaves that are scored first, and queries of a block that are searched at the same time.
NEAREST, TOGETHER = 8, 128


class Gnat:
    """The tree over the rows of ``points``, which carry an identifier and a label number each."""

    FIELDS = ("ids", "labels", "points", "begin", "end", "first", "count", "near", "far", "split", "only")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        norms = (self.points.astype(np.float64) ** 2).sum(axis=1)
        self.largest = float(norms.max(initial=0.0))

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> Gnat:
        order = np.arange(len(ids))
        raised = points.astype(np.float64)
        norms = (raised**2).sum(axis=1)
        largest = norms.max(initial=0.0)
        raised = np.column_stack([raised, np.sqrt(np.maximum(largest - norms, 0))])

        def distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(2 * largest - 2 * (raised[rows] @ raised[to].T), 0))

        begin, end, first, count, only = [], [], [], [], []
        near, far, split = [], [], []

        def node(a: int, b: int) -> int:
            found = labels[order[a:b]]
            begin.append(a)
            end.append(b)
            first.append(-1)
            count.append(0)
            only.append(int(found[0]) if (found == found[0]).all() else MIXED)
            # As seen from the split points of the parent, filled in by it.
            near.append(np.zeros(fanout))
            far.append(np.full(fanout, np.inf))
            split.append(-1)
            return len(begin) - 1

        todo = [node(0, len(ids))] if len(ids) else []
        while todo:
            at = todo.pop()
            a, b = begin[at], end[at]
            if b - a <= leaf:
                continue
            tried = order[np.linspace(a, b - 1, TRIED).astype(np.int64)]
            between = distances(tried, tried)
            chosen, closest = [0], between[0].copy()
            while len(chosen) < fanout and closest.max() > 0:
                chosen.append(int(closest.argmax()))
                closest = np.minimum(closest, between[chosen[-1]])
            chosen = list(dict.fromkeys(chosen))
            to = distances(order[a:b], tried[chosen])
            cell = to.argmin(axis=1)
            sizes = np.bincount(cell, minlength=len(chosen))
            if sizes.max() == b - a:
                continue
            by_cell = np.argsort(cell, kind="stable")
            order[a:b] = order[a:b][by_cell]
            to, edges = to[by_cell], np.concatenate([[0], np.cumsum(sizes)])
            cells = np.flatnonzero(sizes)
            first[at], count[at] = len(begin), len(cells)
            for c in cells:
                child = node(a + edges[c], a + edges[c + 1])
                mine = to[edges[c] : edges[c + 1]][:, cells]
                near[child][: len(cells)], far[child][: len(cells)] = mine.min(axis=0), mine.max(axis=0)
                split[child] = int(tried[chosen[c]])
                todo.append(child)
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        split_rows = np.array(split, dtype=np.int64)
        split_rows[split_rows >= 0] = place[split_rows[split_rows >= 0]]
        numbers = {"begin": begin, "end": end, "first": first, "count": count, "only": only}
        return cls(
            ids=ids[order],
            labels=labels[order],
            points=points[order],
            near=np.array(near).reshape(-1, fanout),
            far=np.array(far).reshape(-1, fanout),
            split=split_rows,
            **{name: np.array(values, dtype=np.int64) for name, values in numbers.items()},
        )

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Gnat:
        with np.load(io.BytesIO(raw)) as arrays:
            return cls(**{name: arrays[name] for name in cls.FIELDS})

    def search(
        self,
        queries: np.ndarray,
        own: np.ndarray,
        label: np.ndarray,
        same: bool,
        k: int,
        low: np.ndarray,
        high: np.ndarray,
    ) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """``(ids, scores)`` of the best ``k`` rows in each window ``low <= score <= high`` of every query.

        ``low`` and ``high`` have a row per query and a column per window. Rows of the query's identifier
        ``own`` are left out, as are those whose label is another (``same``) or the given one (otherwise).
        The leaves nearest to a query are scored first; the k-th scores they give narrow its annuli, and
        siblings are eliminated once more before the rest is scored.
        """
        self.scored = 0
        if not len(self.ids) or not len(queries):
            nothing = np.empty(0, np.int64), np.empty(0, np.int64)
            return [[nothing] * low.shape[1] for _ in range(len(queries))]
        width = max(queries.shape[1], self.points.shape[1])
        queries, points = _padded(queries, width), _padded(self.points, width)
        real = queries.astype(np.float64)
        # Whole numbers below 2**53 in all sums: floating point is exact there, and has fast kernels.
        sizes = [max(1, int(np.abs(x).max(initial=0))) for x in (queries, points)]
        exact = sizes[0] * sizes[1] * width < 2**53
        left, right = (real, points.astype(np.float64)) if exact else (queries, points)

        square = (real**2).sum(axis=1) + self.largest
        margin = MARGIN * (1 + np.sqrt(square))[:, None]
        inner = np.sqrt(np.maximum(square[:, None] - 2.0 * high, 0)) - margin
        need = low.copy()

        def outer() -> np.ndarray:
            beyond = square[:, None] - 2.0 * need
            return np.where((beyond < -margin) | (low > high), -1.0, np.sqrt(np.maximum(beyond, 0)) + margin)

        reach = outer()
        lower, upper = np.zeros((len(queries), len(self.begin))), np.full((len(queries), len(self.begin)), np.inf)
        alive = np.zeros(lower.shape, bool)
        wanted = (self.only == MIXED) | ((self.only == label[:, None]) == same)
        alive[:, 0] = wanted[:, 0]
        # Children have larger numbers than their parents.
        for at in np.flatnonzero(self.count):
            rows = np.flatnonzero(alive[:, at])
            if not len(rows):
                continue
            children = slice(self.first[at], self.first[at] + self.count[at])
            to_splits = real[rows] @ points[self.split[children]].T.astype(np.float64)
            d = np.sqrt(np.maximum(square[rows, None] - 2 * to_splits, 0))[:, None, :]
            near, far = (x[children, : self.count[at]] for x in (self.near, self.far))
            lower[rows, children] = np.maximum(np.maximum(d - far, near - d).max(axis=2), lower[rows, at][:, None])
            upper[rows, children] = np.minimum((d + far).min(axis=2), upper[rows, at][:, None])
            meets = (lower[rows, children][:, :, None] <= reach[rows][:, None]) & (
                upper[rows, children][:, :, None] >= inner[rows][:, None]
            )
            alive[rows, children] = meets.any(axis=2) & wanted[rows, children]

        leaves = np.flatnonzero(self.count == 0)
        lower, upper, alive = lower[:, leaves], upper[:, leaves], alive[:, leaves]
        scores = np.full((len(queries), len(self.ids)), NOT_SCORED, np.int64)

        def score(chosen: np.ndarray) -> None:
            for n in np.flatnonzero(chosen.any(axis=0)):
                rows, mine = np.flatnonzero(chosen[:, n]), slice(self.begin[leaves[n]], self.end[leaves[n]])
                found = (left[rows] @ right[mine].T).astype(np.int64)
                fits = (self.ids[mine] != own[rows, None]) & ((self.labels[mine] == label[rows, None]) == same)
                scores[rows, mine] = np.where(fits, found, NOT_SCORED)
                self.scored += found.size

        nearest = np.argsort(np.where(alive, lower, np.inf), axis=1, kind="stable")[:, :NEAREST]
        first = np.zeros_like(alive)
        np.put_along_axis(first, nearest, True, axis=1)
        first &= alive
        score(first)
        for row in range(len(queries)):
            for w in range(low.shape[1]):
                good = scores[row][(scores[row] >= low[row, w]) & (scores[row] <= high[row, w])]
                if len(good) >= k:
                    need[row, w] = np.partition(good, len(good) - k)[len(good) - k]
        reach = outer()
        meets = (lower[:, :, None] <= reach[:, None]) & (upper[:, :, None] >= inner[:, None])
        score(alive & ~first & meets.any(axis=2))

        def best(row: int, w: int) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero((scores[row] >= need[row, w]) & (scores[row] <= high[row, w]))
            reached = scores[row, at]
            if len(at) > k:
                top = reached >= np.partition(reached, len(at) - k)[len(at) - k]
                at, reached = at[top], reached[top]
            order = np.lexsort((self.ids[at], -reached))[:k]
            return self.ids[at][order], reached[order]

        return [[best(row, w) for w in range(low.shape[1])] for row in range(len(queries))]


FOUND = pa.schema([("id", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _windows(lists: pa.ChunkedArray, missing: int) -> np.ndarray:
    """Rows of window bounds, as many in each row; those that are missing are empty windows."""
    rows = lists.to_pylist()
    most = max(map(len, rows))
    return np.array([row + [missing] * (most - len(row)) for row in rows], dtype=np.int64)


def _searched(trees: DataFrame, anchors: DataFrame, shards: int, blocks: int, k: int, same: bool) -> DataFrame:
    """``(id, window, rank, vec_id, score)`` of all anchors ``(id, v, label, home, low, high)`` in all shards."""

    def search(trees: pa.Table, anchors: pa.Table) -> pa.Table:
        if not trees.num_rows or not anchors.num_rows:
            return FOUND.empty_table()
        tree = Gnat.from_bytes(trees["tree"][0].as_py())
        vectors = _matrix(anchors["v"])
        columns: list[list[np.ndarray]] = [[], [], [], []]
        ids, labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        lows, highs = _windows(anchors["low"], 1), _windows(anchors["high"], 0)
        for at in range(0, len(ids), TOGETHER):
            part = slice(at, at + TOGETHER)
            found = tree.search(vectors[part], ids[part], labels[part], same, k, lows[part], highs[part])
            for anchor, windows in zip(ids[part], found, strict=True):
                for window, (vec_ids, scores) in enumerate(windows):
                    columns[0].append(np.full(len(vec_ids), anchor))
                    columns[1].append(np.full(len(vec_ids), window))
                    columns[2].append(vec_ids)
                    columns[3].append(scores)
        flat = [np.concatenate(c or [np.empty(0)]).astype(np.int64) for c in columns]
        return pa.table([pa.array(c, t) for c, t in zip(flat, FOUND.types, strict=True)], schema=FOUND)

    fields = "id long, window int, vec_id long, score long"
    sent = ("id", "v", "label", "low", "high")
    at_home = anchors.select(*sent, F.col("home").alias("shard"))
    found = materialize(trees.groupBy("shard").cogroup(at_home.groupBy("shard")).applyInArrow(search, fields))
    if shards > 1:
        # Where k rows were found at home, the others need not look below the last of them.
        kth = (
            found.groupBy("id", "window")
            .agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
            .where(F.col("kth").isNotNull())
            .groupBy("id")
            .agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("known"))
        )
        raised = F.transform("low", lambda x, n: F.greatest(x, F.coalesce(F.try_element_at("known", n), x)))
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        away = (
            anchors.join(kth, "id", "left")
            .withColumn("low", raised)
            .select(*sent, "home", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
            .where(F.col("shard") != F.col("home"))
            .drop("home")
        )
        dealt = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        others = dealt.groupBy("shard", "block").cogroup(away.groupBy("shard", "block")).applyInArrow(search, fields)
        found = found.unionByName(others)
    best = Window.partitionBy("id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _floor_percent(score: str, percent: int) -> Column:
    """``floor(percent * score / 100)`` in whole numbers."""
    return F.expr(f"({percent} * {score} - pmod({percent} * {score}, 100)) div 100")


def hard_negatives(
    vectors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    anchor_every: int = 100,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    scale: int = SCALE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose identifier ``anchor_every`` divides. An anchor's positives are the best
    ``positives`` rows of its label; the negatives of each positive are the best ``negatives`` rows of
    other labels whose score is between ``window`` percent of the positive's. Ties go to the smaller
    identifier. A positive with a score below 0 has an empty window, one with 0 a window of 0 alone.

    Rows without identifier, label or vector, and vectors with null or non-finite components take no
    part. Of rows that repeat an identifier all are candidates, and the least one (by vector, then label)
    is the anchor; rows of the anchor's own identifier are never its partners. Shorter vectors count as
    having zeros at the end. Scores must fit 58 bits. Other columns do not matter; an empty table gives
    no rows.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(
        F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), scaled(vector, scale).alias("v")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    # Numbered by row, so that an identifier that repeats very often still spreads over all shards.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        tree = Gnat.build(table["id"].to_numpy(), table["label"].to_numpy(), _matrix(table["v"]))
        return pa.table({"shard": table["shard"].slice(0, 1), "tree": pa.array([tree.to_bytes()], pa.binary())})

    trees = materialize(rows.groupBy("shard").applyInArrow(build, "shard int, tree binary"))
    anchors = materialize(
        rows.where(F.col("id") % anchor_every == 0)
        .groupBy("id")
        .agg(F.min(F.struct("v", "label", "shard")).alias("a"))
        .select("id", "a.v", "a.label", F.col("a.shard").alias("home"))
    )
    blocks = max(1, -(-total // anchor_every // BLOCK_ANCHORS))
    whole = anchors.withColumn("low", F.array(F.lit(LEAST))).withColumn("high", F.array(F.lit(MOST)))
    chosen = materialize(
        _searched(trees, whole, shards, blocks, positives, same=True)
        .select("id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank")
        .withColumn("low", -_floor_percent("positive_score", -window[0]))
        .withColumn("high", _floor_percent("positive_score", window[1]))
    )
    # At most ``positives`` rows an anchor.
    windows = chosen.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    sought = anchors.join(windows, "id").select(
        "id", "v", "label", "home", F.col("w.low").alias("low"), F.col("w.high").alias("high")
    )
    mined = _searched(trees, sought, shards, blocks, negatives, same=False)
    return (
        mined.select("id", (F.col("window") + 1).alias("place"), "rank", "vec_id", "score")
        .join(chosen.withColumnRenamed("rank", "place"), ["id", "place"])
        .select(
            F.col("id").alias("anchor_id"),
            "positive_id",
            "rank",
            F.col("vec_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
