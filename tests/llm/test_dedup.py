"""Exact, near and suffix dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from cases import awkward, changed, components, covered, prose, shingles
from pyspark.sql import functions as F

from auditlake.llm import near_dedup, suffix_dedup
from auditlake.llm.anchors import segments
from auditlake.llm.common import batch_bytes
from auditlake.llm.components import components as spark_components
from auditlake.llm.exact_dedup import drop_copies, exact_dedup


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(make_docs, keep):
    rows = awkward()
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    pick = {"max": max, "min": min}[keep]
    expected = sorted(
        (str(d), str(k), len(groups[t or ""]), d == k)
        for d, t in rows
        for k in [pick((x for x in groups[t or ""] if x is not None), default=None)]
    )
    found = exact_dedup(make_docs(rows), keep=keep).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in found) == expected


def test_exact_dedup_rounds(spark):
    """Many runs, so that several rounds are needed."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "cast(id % 700 AS string) AS text").repartition(40)
    found = exact_dedup(docs).collect()
    assert all(r.keep_id % 700 == r.doc_id % 700 and r.keep_id + 700 >= 2000 for r in found)
    assert sum(r.kept for r in found) == 700 and len(found) == 2000


def test_drop_copies_keeps_columns_and_rows_without_identifier(make_docs):
    docs = make_docs([(1, "a"), (2, "a"), (3, None), (4, ""), (None, "a")])
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "None"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200)]
    found = {r.node: r.component for r in spark_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 160))
    assert found[200] == found[201] == 200


def check_near(docs, rows):
    sets = defaultdict(list)
    for doc, text in rows:
        if doc is not None:
            sets[doc].append(shingles(text))
    return sets, near_dedup.near_dedup(docs).collect()


def test_near_dedup_awkward(make_docs):
    rows = [r for r in awkward() if r[0] not in (17,)]
    sets, found = check_near(make_docs(rows), rows)
    expected = components(sets)
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id][0]), expected[r.doc_id]), r
        assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("pairs", [10, 1 << 40])
def test_near_dedup_groups(make_docs, monkeypatch, pairs):
    """By blocks and by pairs: chains, a group around one original that is not the first, and copies below the limit."""
    monkeypatch.setattr(near_dedup, "GROUP_PAIRS", pairs)
    monkeypatch.setattr(near_dedup, "BLOCK_OUTSIDE", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_ALL", 16)
    rows = []
    for group in range(6):
        base = prose(group, 120)
        rows += [(group * 100 + 50, base)]
        rows += [(group * 100 + n, changed(base, 14 + n, n)) for n in range(30)]
    text = prose(99, 150)
    for n in range(12):
        rows.append((900 + n, text))
        text = changed(text, 25, n)
    sets, found = check_near(make_docs(rows), rows)
    expected = components(sets)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert len(set(expected.values())) > 6


@pytest.mark.parametrize("rows", [1, 2048])
def test_only_needed_texts_are_moved(spark, monkeypatch, rows):
    """The filter passes all texts that are needed, and few others unless it is too small for them."""
    monkeypatch.setattr(near_dedup, "FILTER_ROWS", rows)
    needed = spark.range(-9000, 9000, 3).select(F.col("id").alias("doc"))
    known, place = near_dedup._filter_of(needed)
    bits = np.unpackbits(known, bitorder="little")
    passed = {r.doc for r in spark.range(-9000, 9000).select(F.col("id").alias("doc"), place.alias("p")).collect() if bits[r.p]}
    assert passed >= set(range(-9000, 9000, 3))
    assert len(passed) < 6000 + 12000 * (0.1 if rows > 1 else 0.2)
    likely = near_dedup._likely(spark.range(-9000, 9000).withColumnRenamed("id", "doc"), needed, "doc").collect()
    assert sorted(r.doc for r in likely) == sorted(passed)
    docs = spark.range(40).selectExpr("id AS doc", "concat('some words of ', id) AS text").repartition(3)
    full = near_dedup._full_texts(docs.where("doc % 4 = 1").selectExpr("doc AS rep"), docs)
    assert sorted(r.doc for r in full.collect()) == list(range(1, 40, 4))


def test_signatures_of_large_sets_do_not_agree_by_chance():
    rng = np.random.default_rng(5)
    made = np.array([near_dedup.signature(rng.integers(0, 2**63, 20_000, dtype=np.uint64)) for _ in range(300)])
    assert all(len(np.unique(made[:, k])) == 300 for k in range(near_dedup.COORDINATES))


def classes_of(spark, made):
    rows = [(n, 100, bytes([n % 256, n // 256]), values.astype(np.uint32).tobytes()) for n, values in enumerate(made)]
    return spark.createDataFrame(rows, "rep long, n long, digest binary, signature binary")


def test_classes_that_share_values_by_chance_are_not_posted(spark):
    """Nearly all values are shared, but only two classes have enough of them in common."""
    rng = np.random.default_rng(11)
    made = rng.integers(0, 400, (800, near_dedup.COORDINATES))
    made[799] = made[0]
    made[799, rng.permutation(near_dedup.COORDINATES)[near_dedup.MATCHES + 4 :]] += 1000
    posted = near_dedup._postings(classes_of(spark, made)).select("rep").distinct().collect()
    assert {r.rep for r in posted} == {0, 799}


def test_no_class_of_a_linked_pair_is_left_out(spark):
    """Pairs that agree in as many coordinates as sets at the limit mostly do."""
    rng = np.random.default_rng(12)
    made = np.repeat(rng.integers(0, 2**32, (1000, near_dedup.COORDINATES)), 2, axis=0)
    made[1::2] += rng.random((1000, near_dedup.COORDINATES)) >= near_dedup.SIMILAR / near_dedup.OF
    able = near_dedup._able_to_link(classes_of(spark, made % 2**32))
    assert sorted(r.rep for r in able.collect()) == list(range(2000))


def test_near_dedup_empty(make_docs):
    assert near_dedup.near_dedup(make_docs([])).collect() == []
    alone = near_dedup.near_dedup(make_docs([(1, None), (2, "")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in alone) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_word_longer_than_a_block(monkeypatch):
    text = "start " + "y" * 5000 + " middle " + "z " * 3000 + "end"
    whole = near_dedup.word_hashes(text)
    assert len(whole) == 3004
    monkeypatch.setattr(near_dedup, "BLOCK", 1000)
    parts = near_dedup.word_hashes(text)
    # Words of ordinary length have the same hash wherever a block begins.
    assert len(parts) == len(whole) and (parts[[0, 2, 3, -1]] == whole[[0, 2, 3, -1]]).all()


def test_repeated_places():
    rng = random.Random(3)
    for trial in range(150):
        size = rng.randint(1, 90)
        symbols = [rng.choice([0, 1, 2, 3] if trial % 2 else [1, 2]) for _ in range(size)]
        for width in (1, 2, 5, 9):
            grams = [tuple(symbols[i : i + width]) for i in range(size)]
            whole = [len(g) == width and 0 not in g for g in grams]
            expected = [w and grams.count(g) > 1 for w, g in zip(whole, grams, strict=True)]
            found, heads = suffix_dedup.repeated_places(np.array(symbols, np.int16), width)
            assert found.tolist() == expected
            kinds = {g for g, e in zip(grams, expected, strict=True) if e}
            assert sorted(grams[i] for i in np.flatnonzero(heads)) == sorted(kinds)


def test_segments_hold_every_window_once():
    texts = [prose(n, 40 + n) for n in range(12)] + ["ab" * 300, "x" * 199, "", "é" * 150]
    data, ends = batch_bytes(texts)
    seen = []
    keys = {}
    for start, windows, key, _ in segments(data, ends, 60, 20):
        for s, w, k in zip(start.tolist(), windows.tolist(), key.tolist(), strict=True):
            seen += range(s, s + w)
            for at in range(s, s + w):
                keys.setdefault(data[at : at + 60].tobytes(), set()).add(k)
    wanted = [at for a, b in zip(ends[:-1], ends[1:], strict=True) for at in range(a, b - 59)]
    assert sorted(seen) == wanted
    assert all(len(k) == 1 for k in keys.values())


def check_suffix(docs, rows, width):
    expected = sorted(
        (str(d), len(f), bytes(x for x, gone in zip((t or "").encode(), f, strict=True) if not gone))
        for (d, t), f in zip(rows, covered([t for _, t in rows], width), strict=True)
    )
    found = suffix_dedup.suffix_dedup(docs, width, 20).collect()
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.kept)) for r in found) == expected
    assert all(r.n_bytes - len(r.kept) == sum(s.end - s.begin for s in r.spans) for r in found)


def test_suffix_dedup_awkward(make_docs):
    rows = [(d, t[:6000] if t else t) for d, t in awkward()]
    check_suffix(make_docs(rows), rows, 60)


def test_suffix_dedup_hot_passage(make_docs, monkeypatch):
    """One passage in many surroundings goes by the route for hot anchors."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 5)
    passage = prose(7, 25)
    rows = [(n, f"{prose(100 + n, 20)} {passage} {prose(200 + n // 3, 20)}") for n in range(30)]
    check_suffix(make_docs(rows), rows, 60)


def test_suffix_dedup_long_text_is_cut_into_blocks(make_docs, monkeypatch):
    from auditlake.llm import anchors

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, text), (2, "start" + text[1000:1400] + "end"), (3, text[3990:4300])]
    data, ends = batch_bytes([t for _, t in rows])
    monkeypatch.setattr(anchors, "BLOCK", 1000)
    seen = [at for s, w, _, _ in segments(data, ends, 60, 20) for x, y in zip(s, w, strict=True) for at in range(x, x + y)]
    assert sorted(seen) == [at for a, b in zip(ends[:-1], ends[1:], strict=True) for at in range(a, b - 59)]
    check_suffix(make_docs(rows), rows, 60)


def test_spans_of_a_text_of_one_byte_are_merged_before_they_are_gathered(spark):
    """Every byte begins a repeated window; what is gathered is one span a part, in every copy."""
    text, part = "x" * 100_000, suffix_dedup.SPAN_PART
    docs = spark.createDataFrame([(1, 7, text), (1, 7, text), (2, 8, "y" * 150)], "doc long, tid long, text string")
    found = suffix_dedup.repeated_spans(docs.repartition(2)).collect()
    assert [(r.doc, r.tid) for r in found] == [(1, 7)]
    assert len(found[0].spans) == -(-len(text) // part)
    assert suffix_dedup.merge_spans(found[0].spans) == [(0, len(text))]


def test_gathered_spans_cover_what_single_spans_cover(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPAN_PART", 64)
    rng = random.Random(3)
    rows = [(d, d % 3, b, b + rng.randint(1, 150)) for d in range(8) for b in rng.choices(range(900), k=12)]
    found = suffix_dedup._gathered(spark.createDataFrame(rows, "doc long, tid long, begin long, end long")).collect()
    assert sorted((r.doc, r.tid) for r in found) == sorted({r[:2] for r in rows})
    for r in found:
        mine = [{"begin": b, "end": e} for d, _, b, e in rows if d == r.doc]
        assert suffix_dedup.merge_spans(r.spans) == suffix_dedup.merge_spans(mine)


def test_drop_passages_keeps_columns_and_whole_characters(make_docs):
    rows = [(d, t[:3000] if t else t) for d, t in awkward()] + [(30, "é日" * 90), (31, "日" + "é日" * 60)]
    found = suffix_dedup.drop_passages(make_docs(rows), 60, 20)
    assert found.columns == make_docs(rows).columns
    expected = []
    for (d, t), flags in zip(rows, covered([t for _, t in rows], 60), strict=True):
        kept, at = "", 0
        for c in t or "":
            size = len(c.encode())
            kept += "" if all(flags[at : at + size]) else c
            at += size
        expected.append((str(d), kept, "d"))
    assert sorted((str(r.doc_id), r.text, r.digest) for r in found.collect()) == sorted(expected)


def test_suffix_dedup_empty(make_docs):
    assert suffix_dedup.suffix_dedup(make_docs([])).collect() == []


def test_whole_characters_stay():
    text = "aé日b"
    raw = text.encode()
    for begin in range(len(raw)):
        for end in range(begin, len(raw) + 1):
            kept = suffix_dedup.whole_characters(text, [{"begin": begin, "end": end}])
            at, expected = 0, ""
            for c in text:
                size = len(c.encode())
                if not (begin <= at and at + size <= end):
                    expected += c
                at += size
            assert kept == expected
    assert hashlib.sha256(text.encode()).hexdigest()
