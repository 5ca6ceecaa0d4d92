"""Toxicity by weak supervision: lexicon and pattern voters, a label model, a linear classifier.

1. **Voters.** From a bounded sample of learnable labelled rows come words and word beginnings that mark
   toxic texts. They are dealt to ``LEXICONS`` word lists and to lists of beginnings of 4 and 5 letters,
   and two more voters ask for two and for four different marks. Each voter fires or not on a text.
2. **Label model.** The voters run over all documents; Spark adds up how often each fires and each pair
   fires together, ``(voters + 1)**2`` numbers whatever the size of the corpus. Given the class, voters
   are taken as independent but for pairs found correlated: the covariance of two voters is then a
   product ``d_j * d_k``, which is fitted to the pairs that follow it; a pair whose covariance lies far
   above its product is correlated, leaves the fit, and the voters of such pairs share their weight.
   ``d`` and the firing rates give how often each voter fires on toxic and on clean texts, from
   unlabelled data alone but for the share of toxic texts, which the learnable labels give.
3. **Classifier.** The model's posterior labels, not the given ones, train a logistic regression on words
   and word beginnings of the sample. It scores every whole text.

The bounds (``PER_CLASS`` documents of either class, ``MARKS`` marks, ``FEATURES`` classifier features)
hold for fitting. Voting and scoring run where the rows are; nothing is shuffled but the sums.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import in_slices, release, text_or_empty, texts_of
from auditlake.llm.labelled import fold, labelled_sample

PER_CLASS, MARKS, FEATURES = 2_000, 2_000, 4_000
# A feature counts when chance explains its class balance in fewer than one of exp(14) cases; a mark is
# also exp(4) times as frequent in toxic texts.
SURPRISE, ODDS = 14.0, 4.0
# Weight of a voter that does not fire.
SILENCE = 0.5
LEXICONS, SHORT_LISTS, LONG_LISTS = 8, 4, 4
FOLDS, HELD_OUT = 5, 0
KNOWN_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """The distinct words of a text in lower case."""
    return set(WORD.findall(text.lower()))


def marks_of(word: str) -> tuple[str, ...]:
    """A word with its beginnings; ``word*`` stands for all words that begin so."""
    return (word, f"{word[:4]}*", f"{word[:5]}*") if len(word) >= 4 else (word,)


def features_of(text: str) -> set[str]:
    return {mark for word in words_of(text) for mark in marks_of(word)}


def features_in(texts: Iterator[str]) -> Iterator[tuple[str, ...]]:
    """The features of each text; equal features are one string, and a tuple is a fraction of a set."""
    known: dict[str, str] = {}
    for text in texts:
        yield tuple(known.setdefault(feature, feature) for feature in features_of(text))


@dataclass
class Voters:
    """Lists of marks; each is a voter, and so is having at least so many different marks."""

    lists: list[list[str]]
    at_least: tuple[int, ...] = (2, 4)
    lists_of: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.lists_of = {mark: n for n, marks in enumerate(self.lists) for mark in marks}

    def __len__(self) -> int:
        return len(self.lists) + len(self.at_least)

    def vote(self, features: Collection[str]) -> np.ndarray:
        fired = np.zeros(len(self), dtype=np.int64)
        hits = self.lists_of.keys() & features
        words = 0
        for mark in hits:
            fired[self.lists_of[mark]] = 1
            words += not mark.endswith("*")
        for n, least in enumerate(self.at_least):
            fired[len(self.lists) + n] = words >= least
        return fired


def without_copies(sample: Iterator[tuple[int, Collection[str]]]) -> list[tuple[int, Collection[str]]]:
    """The sample without near copies, whose common words would look like marks.

    A text goes if four of five MinHash values of its words agree with one that stays.
    """
    factors = np.random.default_rng(5).integers(1, 2**31, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: set[tuple] = set()
    kept = []
    for label, features in sample:
        hashes = np.array([zlib.crc32(f.encode()) for f in features if not f.endswith("*")] or [0], dtype=np.uint64)
        least = ((hashes[:, None] * factors) & np.uint64(0xFFFFFFFF)).min(axis=0).tolist()
        fours = {(n, *least[:n], *least[n + 1 :]) for n in range(5)}
        if not fours & seen:
            kept.append((label, features))
            seen |= fours
    return kept


def surprise(rows: float, hits: float, share: float) -> float:
    """Log-likelihood ratio of ``hits`` among ``rows`` against hits at the common share."""
    misses = rows - hits
    total = hits * np.log(hits / (rows * share)) if hits > 0 else 0.0
    return total + (misses * np.log(misses / (rows * (1 - share))) if misses > 0 else 0.0)


def make_voters(sample: list[tuple[int, Collection[str]]]) -> Voters:
    """Voters from labelled feature sets: marks with far higher odds among toxic texts."""
    counts: dict[str, list[int]] = {}
    total = [0, 0]
    for label, features in sample:
        total[label] += 1
        for feature in features:
            counts.setdefault(feature, [0, 0])[label] += 1
    share = total[1] / sum(total)
    scored = []
    for feature, (clean, toxic) in counts.items():
        odds = np.log((toxic + 0.5) / (total[1] + 1)) - np.log((clean + 0.5) / (total[0] + 1))
        if odds > ODDS and surprise(clean + toxic, toxic, share) > SURPRISE:
            scored.append((-toxic, -odds, feature))
    marks = [feature for *_, feature in sorted(scored)[:MARKS]]
    words = [m for m in marks if not m.endswith("*")]
    short = [m for m in marks if m.endswith("*") and len(m) == 5]
    long = [m for m in marks if m.endswith("*") and len(m) == 6]
    lists = [
        *(words[n::LEXICONS] for n in range(LEXICONS)),
        *(short[n::SHORT_LISTS] for n in range(SHORT_LISTS)),
        *(long[n::LONG_LISTS] for n in range(LONG_LISTS)),
    ]
    return Voters(lists)


@dataclass
class LabelModel:
    """Firing rates of the voters by class, their weights, and the share of class 1."""

    share: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    weight: np.ndarray
    correlated: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of votes.

        A voter that does not fire counts by ``SILENCE`` only, because a short toxic text has few marks.
        """
        fired = np.log(self.on_toxic / self.on_clean) * self.weight
        silent = np.log((1 - self.on_toxic) / (1 - self.on_clean)) * self.weight * SILENCE
        odds = np.log(self.share / (1 - self.share)) + votes @ fired + (1 - votes) @ silent
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_label_model(together: np.ndarray, share: float, rounds: int = 10) -> LabelModel:
    """The label model from counts: ``together[j, k]`` rows on which voters j and k fire; the last
    row and column stand for all rows."""
    rows = max(int(together[-1, -1]), 1)
    rate = together[-1, :-1] / rows
    voters = len(rate)
    covariance = together[:-1, :-1] / rows - np.outer(rate, rate)
    used = ~np.eye(voters, dtype=bool)
    correlated = np.zeros((voters, voters), dtype=bool)
    d = np.sqrt(np.maximum(rate * (1 - rate), 1e-12)) * 0.5
    fires = rate > 0
    for _ in range(rounds):
        for _ in range(100):
            # The median, so that a pair not yet known to be correlated does not pull the product up.
            fitted = np.array(
                [
                    np.median(covariance[j, used[j] & fires] / d[used[j] & fires]) if (used[j] & fires).any() else 0
                    for j in range(voters)
                ]
            )
            d = 0.5 * d + 0.5 * np.maximum(fitted, 1e-9)
        spread = np.sqrt(np.outer(rate * (1 - rate), rate * (1 - rate))) + 1e-12
        excess = (covariance - np.outer(d, d)) / spread
        found = (excess > 0.2) & ~np.eye(voters, dtype=bool)
        # Every voter keeps two partners at least, the ones that follow the product best.
        if (found == correlated).all():
            break
        correlated = found
        used = ~np.eye(voters, dtype=bool) & ~correlated
        for j in np.flatnonzero(used.sum(axis=1) < 2):
            best = np.argsort(np.where(np.arange(voters) == j, np.inf, excess[j]))[:2]
            used[j, best] = True
    share = float(np.clip(share, 0.001, 0.5))
    gap = np.minimum(d / np.sqrt(share * (1 - share)), 1.0)
    on_toxic = np.clip(rate + (1 - share) * gap, 1e-3, 1 - 1e-3)
    on_clean = np.clip(rate - share * gap, 1e-5, 1 - 1e-3)
    on_clean = np.minimum(on_clean, on_toxic)
    weight = 1 / (1 + correlated.sum(axis=1))
    return LabelModel(share, on_toxic, on_clean, weight, correlated)


def count_votes(docs: DataFrame, voters: Voters, text: str = "text") -> np.ndarray:
    """How often voters fire together over all rows; the last row and column count all rows."""
    size = len(voters) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, size), dtype=np.int64)
        for batch in in_slices(batches):
            votes = np.array([[*voters.vote(features_of(t)), 1] for t in texts_of(batch.column(0))])
            sums += votes.T @ votes
        j, k = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(k), pa.array(sums[j, k])], ["j", "k", "n"])

    sums = (
        docs.select(text_or_empty(text).alias("text"))
        .mapInArrow(run, "j long, k long, n long")
        .groupBy("j", "k")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    together = np.zeros((size, size), dtype=np.int64)
    for row in sums:
        together[row["j"], row["k"]] = row["n"]
    return together


def train_linear(
    features: list[Collection[str]], posterior: np.ndarray, steps: int = 800, rate: float = 5.0, decay: float = 1e-4
) -> tuple[dict[str, float], float]:
    """Logistic regression on posterior labels: weights by feature, and the bias."""
    sums: dict[str, np.ndarray] = {}
    for present, p in zip(features, posterior, strict=True):
        for feature in present:
            sums.setdefault(feature, np.zeros(2))
            sums[feature] += (1, p)
    mean = posterior.mean()
    common = [(surprise(n, hit, mean), feature) for feature, (n, hit) in sums.items()]
    chosen = [feature for _, feature in sorted(x for x in common if x[0] > SURPRISE)[::-1][:FEATURES]]
    index = {feature: n for n, feature in enumerate(chosen)}
    rows, columns = [], []
    for row, present in enumerate(features):
        mine = sorted(index[f] for f in index.keys() & present)
        rows += [row] * len(mine)
        columns += mine
    rows, columns = np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64)
    weights, bias = np.zeros(len(chosen)), float(np.log(mean / (1 - mean)))
    square, square_bias = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(steps):
        odds = bias + np.bincount(rows, weights[columns], len(features))
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - posterior) / len(features)
        gradient = np.bincount(columns, error[rows], len(chosen)) + decay * weights
        square += gradient**2
        square_bias += error.sum() ** 2
        weights -= rate * 0.1 * gradient / np.sqrt(square)
        bias -= rate * 0.1 * error.sum() / np.sqrt(square_bias)
    return dict(zip(chosen, weights.tolist(), strict=True)), bias


class Scorer:
    """Scores texts; remembers the weight of words in a table of bounded size."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words: dict[str, tuple[str, ...]] = {}

    def _marks(self, word: str) -> tuple[str, ...]:
        found = tuple(m for m in marks_of(word) if m in self.weights)
        if len(self.words) >= KNOWN_WORDS:
            self.words.clear()
        self.words[word] = found
        return found

    def score(self, text: str) -> float:
        present: set[str] = set()
        known = self.words.get
        for word in words_of(text):
            found = known(word)
            present.update(self._marks(word) if found is None else found)
        odds = self.bias + sum(sorted(self.weights[m] for m in present))
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


@dataclass
class ToxicityModel:
    """What training gives: the voters, their label model, the classifier."""

    voters: Voters
    label_model: LabelModel
    weights: dict[str, float]
    bias: float


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id: str = "doc_id"
) -> ToxicityModel | None:
    """The fitted model, or None if the learnable rows lack one of the classes."""
    learnable = fold(id, FOLDS) != HELD_OUT
    sample = labelled_sample(docs, labels, label, learnable, PER_CLASS, text, id)
    rows = sorted((r["id"], r["label"], r["text"]) for r in sample.collect())  # bounded by PER_CLASS
    features = features_in(text for *_, text in rows)
    known = without_copies((value, found) for (_, value, _), found in zip(rows, features, strict=True))
    del rows, features
    if len({value for value, _ in known}) < 2:
        return None
    counted = labels.where(learnable & F.col(label).isin(0, 1)).agg(F.avg(label).alias("share")).first()
    voters = make_voters(known)
    model = fit_label_model(count_votes(docs, voters, text), counted["share"])
    votes = np.array([voters.vote(features) for _, features in known])
    weights, bias = train_linear([features for _, features in known], model.posterior(votes))
    del known
    release(docs.sparkSession)
    return ToxicityModel(voters, model, weights, bias)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``.

    Only the text is scored. Null and empty texts have no words and get the classifier's bias as
    evidence. Without labels of both classes every score is 0. Repeated rows get the same score, rows
    without identifier are scored too and not held out; other columns do not matter.
    """
    model = train(docs, labels, label, text, id)
    weights, bias = (model.weights, model.bias) if model else ({}, -30.0)
    rows = docs.select(F.col(id).alias("id"), fold(id, FOLDS).alias("fold"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, bias)
        for batch in in_slices(batches):
            scores = [scorer.score(t) for t in texts_of(batch.column(2))]
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


def keep_clean(docs: DataFrame, model: ToxicityModel | None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below 0.5."""
    if model is None:
        return docs
    weights, bias = model.weights, model.bias
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, bias)
        for batch in in_slices(batches):
            clean = [scorer.score(t) < 0.5 for t in texts_of(batch.column(at))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
