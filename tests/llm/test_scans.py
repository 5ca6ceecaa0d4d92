"""License scan, search, classifiers, and the registered queries."""

import random
import re
import zlib

import numpy as np
import pytest
from cases import awkward, prose
from compare import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from auditlake.llm import kd_search, license_scan, oracle, quality_cnn, queries, toxicity
from auditlake.llm.labelled import labelled_sample
from auditlake.llm.quality_cnn import ByteConvNet, chunks_of


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir) is None


def test_all_thirteen_operators_are_registered():
    numbers = [int(name[2:].split("_")[0]) for name in queries.queries()]
    assert sorted(numbers) == list(range(1, 14))
    assert set(queries.queries()) <= set(entry.queries()) and "pipeline" in entry.queries()


def places(text, phrase):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(license_scan.WORD, lower)
    return len(words), [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]


def test_license_scan(make_docs):
    rows = awkward() + [
        (30, "ALL RIGHTS RESERVED all rights all rights reserved. CC, BY; cc-by cc by-nc"),
        (31, "gnu general public license, version 3. GENERAL PUBLIC LICENSE"),
        (32, "by cc"),
        (33, "General public licenses. Allrights reserved rights reserved"),
        (34, ("noise " * 3000) + "general\npublic\tlicense " + ("noise " * 3000) + "cc by"),
        (35, "Released under the MIT License."),
        (36, "ÀLL rights reserved, all Ünder rights"),
    ]
    found = license_scan.summarize(license_scan.license_scan(make_docs(rows))).collect()
    assert len(found) == len(rows)
    expected = []
    for doc, text in rows:
        number, base, labels = 0, [], set()
        for notice in license_scan.NOTICES:
            number, at = places(text, notice.phrase.split())
            labels |= {notice.label} if at else set()
            if notice.base:
                base += [(a, notice.label) for a in at]
        first = min((a for a, _ in base), default=None)
        last = max((a for a, _ in base), default=None)
        expected.append((str(doc), number, len(base), str(first), str(last), ",".join(sorted({n for _, n in base})), ",".join(sorted(labels))))
    got = [(str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels, r.labels) for r in found]
    assert sorted(got) == sorted(expected)
    score = {r.doc_id: r.score for r in found}
    assert all(0 <= s <= 1 for s in score.values())
    assert score[35] == 1.0 and score[32] == 0.0 and score[31] > score[33]


def test_license_scan_empty(make_docs):
    assert license_scan.license_scan(make_docs([])).collect() == []


def brute_top(vectors, k, every):
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in vectors]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        query = min((v.tolist() for i, v in good if i == q))
        scores = sorted((-int(np.dot(v, query)), i) for i, v in good if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [30, 1000])
def test_top_k(spark, monkeypatch, shard):
    """Several shards, ties, a vector that many rows share, and vectors that take no part."""
    monkeypatch.setattr(kd_search, "SHARD_ROWS", shard)
    monkeypatch.setattr(kd_search, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-8, 9, 6) / 4).tolist()) for i in range(200)]
    rows += [(i, [1.0] * 6) for i in range(200, 260)] + [(50, [0.5] * 6)]
    odd = [(301, None), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] * 6), (350, [float("inf")] * 6), (None, [9.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int, score double")
    found = kd_search.top_k(frame.repartition(4), k=5, query_every=50)
    assert sorted(tuple(r) for r in found.collect()) == brute_top(rows, 5, 50)


def test_top_k_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert kd_search.top_k(spark.createDataFrame([], schema)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [0.5, 0.5])], schema)
    assert sorted(tuple(r) for r in kd_search.top_k(few).collect()) == [(0, 1, 2, 256 * 128 + 512 * 128), (0, 2, 1, 256 * 256)]


def test_tree_boxes_are_tight_and_search_uses_the_known_score():
    rng = np.random.default_rng(1)
    points = rng.integers(-500, 500, (700, 4))
    tree = kd_search.Tree.build(np.arange(700), points, leaf=16)
    for low, high, a, b in zip(tree.low, tree.high, tree.begin, tree.end, strict=True):
        assert (points[tree.ids[a:b]].min(axis=0) == low).all() and (points[tree.ids[a:b]].max(axis=0) == high).all()
    again = kd_search.Tree.from_bytes(tree.to_bytes())
    queries = rng.integers(-500, 500, (20, 4))
    nobody = np.full(20, -1)
    full = again.search(queries, nobody, 5)
    known = np.array([scores[2] for _, scores in full])
    cut = again.search(queries, nobody, 5, known)
    for query, (ids, scores), (some, _) in zip(queries, full, cut, strict=True):
        best = sorted((-int(s), i) for i, s in enumerate(points @ query))[:5]
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)] == best
        assert ids[:3].tolist() == some[:3].tolist()
    assert kd_search.Tree.build(np.arange(50), np.ones((50, 3), np.int64), 4).search(np.ones((1, 3), np.int64), nobody[:1], 3)[0][0].tolist() == [0, 1, 2]


def letters(text):
    """Words with letters in place of digits, as words end where digits begin."""
    return text.translate(str.maketrans("0123456789", "bcdfghjklm"))


TOXIC = "grumbleton zonkish fribblet snarkol wexlout dremmick plunderg quibbost vortigan hexaroon".split()


def toxic_table(spark, rows=960):
    """Every fourth text holds one to four of the toxic words."""
    rng = random.Random(8)
    texts = []
    for i in range(rows):
        words = letters(prose(i, 30 + i % 50)).split()
        if i % 4 == 0:
            for word in rng.sample(TOXIC, rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), word)
        texts.append((i, " ".join(words)))
    labels = [(i, int(i % 4 == 0), int(i % 4 == 0)) for i in range(rows) if i % 7]
    return texts, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, make_docs):
    texts, labels = toxic_table(spark)
    rows = texts + [(2000, None), (2001, ""), (None, "grumbleton zonkish"), (2002, "a " * 50_000 + "grumbleton zonkish")]
    found = toxicity.toxicity_scores(make_docs(rows), labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    wrong = [r for r in found if r.doc_id is not None and r.doc_id < 2000 and r.predicted != (r.doc_id % 4 == 0)]
    assert len(wrong) <= 60 and all(r.doc_id % 4 == 0 for r in wrong)
    special = {r.doc_id: r.predicted for r in found if r.doc_id is None or r.doc_id >= 2000}
    assert special == {2000: 0, 2001: 0, None: 1, 2002: 1}


def test_toxicity_uses_no_held_out_labels(spark, make_docs):
    texts, labels = toxic_table(spark)
    flipped = spark.createDataFrame(
        [(r.doc_id, r.quality, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.toxic) for r in labels.collect()],
        labels.schema,
    )
    docs = make_docs(texts)
    first = toxicity.toxicity_scores(docs, labels).collect()
    second = toxicity.toxicity_scores(docs, flipped).collect()
    assert sorted((r.doc_id, r.score) for r in first) == sorted((r.doc_id, r.score) for r in second)


def test_label_model_finds_rates_and_a_correlated_pair():
    rng = np.random.default_rng(0)
    y = rng.random(200_000) < 0.15
    on, off = np.array([0.7, 0.6, 0.5, 0.8, 0.4, 0.6]), np.array([0.02, 0.05, 0.01, 0.1, 0.03, 0.02])
    votes = (rng.random((len(y), 6)) < np.where(y[:, None], on, off)).astype(np.int64)
    votes = np.column_stack([votes, np.where(rng.random(len(y)) < 0.95, votes[:, 0], votes[:, 1])])
    all_votes = np.column_stack([votes, np.ones(len(y), np.int64)])
    model = toxicity.fit_label_model(all_votes.T @ all_votes, 0.15)
    assert np.abs(model.on_toxic[1:6] - on[1:]).max() < 0.06 and np.abs(model.on_clean[1:6] - off[1:]).max() < 0.02
    assert model.correlated[0, 6] and model.weight[0] == 0.5 and model.weight[2] == 1
    assert ((model.posterior(votes) > 0.5) == y)[votes.any(axis=1)].mean() > 0.9


def test_classifiers_without_labels(spark, make_docs):
    none = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "text"), (2, None)])
    assert {(r.score, r.predicted) for r in quality_cnn.quality_scores(docs, none).collect()} == {(0.5, 1)}
    assert {r.predicted for r in toxicity.toxicity_scores(docs, none).collect()} == {0}
    assert quality_cnn.quality_scores(make_docs([]), none).collect() == []


def test_chunks_cover_the_whole_text():
    for size in (0, 1, 255, 256, 257, 448, 449, 5000):
        raw = bytes(n % 251 + 1 for n in range(size))
        made = chunks_of(raw)
        seen, at = set(), 0
        for chunk in made:
            at = raw.find(chunk.tobytes().rstrip(b"\0"), 0) if size <= 251 else at
            seen.add(chunk.tobytes())
        joined = b"".join(chunk.tobytes() for chunk in made)
        assert made.shape[1] == 256 and set(raw) <= set(joined)
        if size >= 256:
            assert made[0].tobytes() == raw[:256] and made[-1].tobytes() == raw[-256:]
            assert all(raw[n : n + 64] in joined for n in range(size - 64))


def test_network_gradients():
    net = ByteConvNet(3)
    rng = np.random.default_rng(0)
    chunks, target, weight = rng.integers(0, 256, (4, 256)).astype(np.uint8), np.array([0, 1, 1, 0.0]), np.ones(4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}

    def loss():
        z = net.evidence(chunks)
        return float(np.mean(np.log1p(np.exp(z)) - target * z))

    gradients = net._gradients(chunks, target, weight)
    for name, values in net.weights.items():
        flat = values.reshape(-1)
        for n in np.argsort(-np.abs(gradients[name].reshape(-1)))[:3]:
            old, step = flat[n], 1e-6
            flat[n] = old + step
            up = loss()
            flat[n] = old - step
            down = loss()
            flat[n] = old
            assert abs((up - down) / (2 * step) - gradients[name].reshape(-1)[n]) < 1e-5, name


def test_quality(spark, make_docs):
    texts = [(i, prose(i, 80) if i % 2 else " ".join(w.upper() + "!!" for w in prose(i, 80).split())) for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(160)], "doc_id long, quality int, toxic int")
    rows = texts + [(500, None), (501, ""), (None, prose(5)), (502, prose(6, 20_000))]
    found = quality_cnn.quality_scores(make_docs(rows), labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id < 160]
    assert held and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.9 * len(held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)


def test_labelled_sample_is_bounded_by_identifiers(spark):
    """An identifier that thousands of rows repeat is one row of the sample, with its least text."""
    rows = [(1, "b")] * 3000 + [(1, "a")] + [(n, f"text {n}") for n in range(2, 30)] + [(None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(1, 30)] + [(1, 1)], "doc_id long, toxic int")
    found = labelled_sample(docs, labels, "toxic", F.lit(True), per_class=50).collect()
    assert sorted((r.id, r.label, r.text) for r in found) == [(1, 1, "a")] + [(n, n % 2, f"text {n}") for n in range(2, 30)]
    assert len(labelled_sample(docs, labels, "toxic", F.lit(True), per_class=5).collect()) == 10
