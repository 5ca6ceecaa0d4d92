"""The pipeline's stages against brute force, each on its own input."""

import zlib
from collections import defaultdict

import pytest
from cases import components, covered, shingles

import corpus_pipeline
from auditlake.llm.common import materialize


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        found.append((name, docs))
    return found


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns(stages):
    for _, frame in stages[:-1]:
        assert tuple(frame.columns) == corpus_pipeline.DOCUMENTS
    assert [name for name, _ in stages[1:]] == ["toxicity", "exact_dedup", "near_dedup", "suffix_dedup", "best_fit_packing"]


def test_toxicity_keeps_clean_documents(stages, spark, sf_dir):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = rows(stages[0][1]), rows(stages[1][1])
    assert all(before[i] == r for i, r in after.items())
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in clean) >= 0.97 * len(clean)


def test_exact_dedup(stages):
    before, after = rows(stages[1][1]), rows(stages[2][1])
    last = defaultdict(list)
    for i, r in before.items():
        last[r.text or ""].append(i)
    assert set(after) == {max(ids) for ids in last.values()}


def test_near_dedup(stages):
    before, after = rows(stages[2][1]), rows(stages[3][1])
    expected = components({i: [shingles(r.text)] for i, r in before.items()})
    assert set(after) == set(expected.values())


def test_suffix_dedup(stages):
    before, after = rows(stages[3][1]), rows(stages[4][1])
    ids = list(before)
    assert set(after) == set(ids)
    for i, flags in zip(ids, covered([before[i].text for i in ids], 200), strict=True):
        text, at = "", 0
        for c in before[i].text or "":
            size = len(c.encode())
            text += "" if all(flags[at : at + size]) else c
            at += size
        assert (after[i].text, after[i].n_chars) == (text, len(text))
        assert after[i].lang == before[i].lang


def test_packing(stages):
    docs, pieces = rows(stages[4][1]), stages[5][1].collect()
    assert {r.doc_id for r in pieces} == set(docs)
    places = defaultdict(list)
    for r in pieces:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(r.length for r in pieces) // 1024) * 1.05 + 1
    assert zlib.crc32(b"") == 0


def test_awkward_documents(spark, sf_dir, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b", None, "s", 3), (4, "a b", "en", None, 3), (None, "x", None, None, None)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows_ in (("some", data), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows_, schema).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        expected = {"some": [None, 2, 4], "none": []}[name]
        assert sorted((r.doc_id for r in found), key=str) == sorted(expected, key=str)


def test_toxicity_training_holds_little_on_the_driver(spark):
    """Texts that share their words share the strings of their features."""
    import tracemalloc

    from auditlake.llm import toxicity

    words = [f"{a}{b}{c}{d}" for a in "bdfg" for b in "aeiou" for c in "klmnprst" for d in ("ado", "emi", "oru", "usk")]
    texts = [(i, " ".join(words[i % 7 :: 1 + i % 3] + [f"u{chr(97 + i % 26)}q{chr(97 + i // 26)}"] * 2)) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    tracemalloc.start()
    toxicity.train(docs, labels)
    features = list(toxicity.features_in(text for _, text in texts))
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [set(f) for f in features] == [toxicity.features_of(t) for _, t in texts]
    assert len({id(f) for found in features for f in found}) == len({f for found in features for f in found})
    assert peak < 20e6


def test_finished_steps_are_released(spark, monkeypatch):
    """Near dedup frees the driver between its steps, and so do the rounds of components."""
    from auditlake.llm import components as parts
    from auditlake.llm import near_dedup

    calls = []
    for module in (parts, near_dedup):
        free = module.release
        monkeypatch.setattr(module, "release", lambda s, free=free, name=module.__name__: (calls.append(name), free(s)))
    docs = spark.createDataFrame([(i, f"same words here and there {i // 2}") for i in range(6)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()}
    assert found == {i: i - i % 2 for i in range(6)}
    assert calls.count(near_dedup.__name__) >= 4 and calls.count(parts.__name__) >= 2
