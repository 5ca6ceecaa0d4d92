"""Quality score by a byte-level convolutional network in numpy.

The bytes of a text are cut into overlapping chunks that cover all of it. In a chunk every byte is a
learned vector, learned filters slide over them, and each filter's largest response in the chunk goes
into a small layer that gives the chunk's evidence. A document's evidence is the mean over its chunks,
and a logistic function of it is the one probability.

The network is fitted on a bounded sample of labelled rows, ``PER_CLASS`` documents of either class with
at most ``CHUNKS_EACH`` chunks each, spread over the document; these bounds hold for fitting only.
Scoring runs where the rows are: no shuffle, and memory for ``CHUNKS_A_STEP`` chunks at a time whatever
the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import in_slices, text_or_empty, texts_of
from auditlake.llm.labelled import fold, labelled_sample

CHUNK, STEP = 256, 192
PER_CLASS, CHUNKS_EACH = 1_000, 6
CHUNKS_A_STEP = 512
FOLDS, HELD_OUT = 3, 1


def chunks_of(raw: bytes) -> np.ndarray:
    """Overlapping chunks that cover all bytes; the last ends with the text.

    Texts shorter than a chunk are filled up with zeros, the empty text too.
    """
    if len(raw) <= CHUNK:
        padded = np.zeros((1, CHUNK), dtype=np.uint8)
        padded[0, : len(raw)] = np.frombuffer(raw, dtype=np.uint8)
        return padded
    data = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, dtype=np.uint8), CHUNK)
    starts = np.arange(0, len(data) - 1, STEP)
    return data[np.append(starts, len(data) - 1)]


def shortened(chunks: np.ndarray, seed: int = 2) -> np.ndarray:
    """Copies of chunks that end early, as short texts do."""
    lengths = np.random.default_rng(seed).integers(8, CHUNK, len(chunks))
    return np.where(np.arange(CHUNK) < lengths[:, None], chunks, 0).astype(np.uint8)


class ByteConvNet:
    """Byte vectors, filters with a stride, maximum over the chunk, one hidden layer, one output."""

    VECTOR, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 4, 32, 16

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        taps = self.WIDTH * self.VECTOR
        self.weights = {
            "vectors": normal(256, self.VECTOR, scale=0.5),
            "filters": normal(taps, self.FILTERS, scale=(2 / taps) ** 0.5),
            "filter_bias": np.zeros(self.FILTERS, np.float32),
            "hidden": normal(self.FILTERS, self.HIDDEN, scale=(2 / self.FILTERS) ** 0.5),
            "hidden_bias": np.zeros(self.HIDDEN, np.float32),
            "out": normal(self.HIDDEN, scale=self.HIDDEN**-0.5),
            "out_bias": np.zeros(1, np.float32),
        }

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        """Bytes below each filter position: (chunks, positions, width)."""
        return np.lib.stride_tricks.sliding_window_view(chunks, self.WIDTH, axis=1)[:, :: self.STRIDE]

    def _forward(self, chunks: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        below = self._windows(chunks)
        taps = w["vectors"][below].reshape(*below.shape[:2], -1)
        response = taps @ w["filters"]
        at = response.argmax(axis=1)
        pooled = np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + w["filter_bias"]
        features = np.maximum(pooled, 0)
        hidden = np.maximum(features @ w["hidden"] + w["hidden_bias"], 0)
        logit = hidden @ w["out"] + w["out_bias"]
        return {"below": below, "taps": taps, "at": at, "features": features, "hidden": hidden, "logit": logit}

    def evidence(self, chunks: np.ndarray) -> np.ndarray:
        """Log-odds of every chunk."""
        parts = [
            self._forward(chunks[n : n + CHUNKS_A_STEP])["logit"] for n in range(0, len(chunks), CHUNKS_A_STEP)
        ]
        return np.concatenate(parts)

    def score(self, raw: bytes) -> float:
        """The probability that a document is of class 1."""
        return float(1 / (1 + np.exp(-np.clip(self.evidence(chunks_of(raw)).mean(dtype=np.float64), -30, 30))))

    def _gradients(self, chunks: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self._forward(chunks)
        error = ((1 / (1 + np.exp(-f["logit"]))) - target) * weight / len(chunks)
        to_hidden = np.outer(error, w["out"]) * (f["hidden"] > 0)
        to_features = (to_hidden @ w["hidden"].T) * (f["features"] > 0)
        rows = np.arange(len(chunks))[:, None]
        winners = f["taps"][rows, f["at"]]  # chunks, filters, taps
        to_filters = np.einsum("nf,nft->tf", to_features, winners)
        to_taps = to_features[:, :, None] * w["filters"].T[None]
        to_vectors = np.zeros_like(w["vectors"])
        np.add.at(
            to_vectors,
            f["below"][rows, f["at"]].reshape(-1),
            to_taps.reshape(-1, self.VECTOR),
        )
        return {
            "vectors": to_vectors,
            "filters": to_filters,
            "filter_bias": to_features.sum(axis=0),
            "hidden": f["features"].T @ to_hidden,
            "hidden_bias": to_hidden.sum(axis=0),
            "out": f["hidden"].T @ error,
            "out_bias": error.sum(keepdims=True),
        }

    def fit(
        self, chunks: np.ndarray, target: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 3e-3, seed: int = 1
    ) -> None:
        """Adam on the logistic loss of single chunks, with both classes weighing the same."""
        rng = np.random.default_rng(seed)
        share = np.clip(target.mean(), 1e-6, 1 - 1e-6)
        weight = np.where(target > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        steps = epochs * -(-len(chunks) // batch)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(chunks))
            for at in range(0, len(chunks), batch):
                mine = order[at : at + batch]
                step += 1
                now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                for k, g in self._gradients(chunks[mine], target[mine], weight[mine]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.weights[k] -= (
                        now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
                    ).astype(np.float32)


def training_chunks(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of the sampled documents, at most ``CHUNKS_EACH`` of each, with their labels."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_pylist()
            rows = []
            for value, text in zip(label, texts_of(batch.column(1)), strict=True):
                made = chunks_of(text.encode("utf-8", "surrogatepass"))
                spread = np.unique(np.linspace(0, len(made) - 1, CHUNKS_EACH).round().astype(int))
                rows += [(value, made[n].tobytes()) for n in spread]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                ["label", "chunk"],
            )

    made = sample.select("label", "text").mapInArrow(cut, "label int, chunk binary").toArrow()
    # The order in which tasks end must not matter for the fit.
    rows = sorted(zip(made["chunk"].to_pylist(), made["label"].to_pylist(), strict=True))
    chunks = np.frombuffer(b"".join(r[0] for r in rows), dtype=np.uint8).reshape(-1, CHUNK)
    return chunks, np.array([r[1] for r in rows], dtype=np.float32)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id: str = "doc_id"
) -> ByteConvNet | None:
    """The fitted network, or None if the learnable rows lack one of the classes."""
    sample = labelled_sample(docs, labels, label, fold(id, FOLDS) != HELD_OUT, PER_CLASS, text, id)
    chunks, target = training_chunks(sample)
    if len(np.unique(target)) < 2:
        return None
    third = slice(None, None, 3)
    net = ByteConvNet()
    net.fit(np.concatenate([chunks, shortened(chunks[third])]), np.concatenate([target, target[third]]))
    return net


def quality_scores(
    docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``.

    Only the text is scored. Null and empty texts are scored as one chunk of zeros. Without labels of
    both classes every score is 0.5. Repeated rows get the same score, rows without identifier are
    scored too and not held out; other columns do not matter.
    """
    net = train(docs, labels, label, text, id)
    rows = docs.select(F.col(id).alias("id"), fold(id, FOLDS).alias("fold"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            raws = [t.encode("utf-8", "surrogatepass") for t in texts_of(batch.column(2))]
            scores = [0.5 if net is None else net.score(raw) for raw in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["id", "fold", "score"]
            )

    kind = docs.schema[id].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fold long, score double").select(
        F.col("id").alias(id),
        (F.col("id").isNotNull() & (F.col("fold") == HELD_OUT)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
