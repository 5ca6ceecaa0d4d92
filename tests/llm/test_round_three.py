"""Hard negatives, Feistel sharding and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditlake.llm import hard_negatives, sharding, spelling_variants
from auditlake.llm.hard_negatives import LEAST, MOST, Gnat
from auditlake.llm.queries import queries
from auditlake.llm.spelling_variants import Dictionary, Words, gram_codes, near_words

VECTORS = "vec_id long, embedding array<double>, label int, extra string"


# ---- op11 --------------------------------------------------------------------------------------


def brute_negatives(rows, positives=5, negatives=10, every=100):
    """Rows are ``(id, whole numbers, label)``; one per identifier is the anchor."""
    anchors = {}
    for i, v, label in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (v, label)), (v, label))
    out = []
    for i, (v, label) in anchors.items():
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for j, w, other in rows if j != i]
        best = sorted((-s, j) for s, j, other in scored if other == label)[:positives]
        for minus, j in best:
            p = -minus
            fits = sorted((-s, n) for s, n, other in scored if other != label and 30 * p <= 100 * s <= 90 * p)
            out += [(i, j, r + 1, n, p, -s) for r, (s, n) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def vector_rows(count, seed=0, width=6, step=10):
    """Clusters by label, ties, repeated vectors, and identifiers of which every tenth is an anchor."""
    rng = random.Random(seed)
    middle = {n: [rng.choice((0, 0, 16, 48)) for _ in range(width)] for n in range(4)}
    rows = []
    for n in range(count):
        label = 1 if n % 3 == 0 else rng.randrange(4)
        v = middle[label] if n % 5 == 0 else [x + rng.randrange(-8, 9) for x in middle[label]]
        rows.append((n * step, list(v), label))
    return rows


def as_floats(rows):
    return [(i, [x / 256 for x in v], label, "x") for i, v, label in rows]


@pytest.mark.parametrize("shard_rows", [10_000, 70])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 2)
    rows = vector_rows(400)
    found = mined(hard_negatives.hard_negatives(spark.createDataFrame(as_floats(rows), VECTORS)))
    assert found == brute_negatives(rows)
    assert len(found) > 300


def test_hard_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 2], 1), (0, [1, 1], 1), (100, [0, 0], 2), (5, [2, 3, 1], 1), (5, [2, 3, 1], 1), (6, [1, 1], 2), (7, [], 2)]
    bad = [
        (200, None, 1, ""), (300, [1.0, None], 1, ""), (400, [nan], 1, ""), (500, [inf, 1.0], 2, ""), (600, [1.0, 1.0], None, ""),
        (None, [1.0, 1.0], 1, ""),
    ]
    df = spark.createDataFrame(as_floats(rows) + bad, VECTORS).withColumnsRenamed({"extra": "shard"})
    padded = [(i, v + [0] * (3 - len(v)), label) for i, v, label in rows]
    assert mined(hard_negatives.hard_negatives(df)) == brute_negatives(padded)
    assert mined(hard_negatives.hard_negatives(df.limit(0))) == []


def test_window_bounds_are_whole_and_exact(spark):
    scores = [(-101,), (-1,), (0,), (1,), (3,), (10,), (99,), (1000,)]
    df = spark.createDataFrame(scores, "s long")
    low, high = -hard_negatives._floor_percent("s", -30), hard_negatives._floor_percent("s", 90)
    for s, a, b in df.select("s", low, high).collect():
        assert 100 * (a - 1) < 30 * s <= 100 * a and 100 * b <= 90 * s < 100 * (b + 1)


def test_tree_eliminates_siblings_and_stays_exact():
    rng = np.random.default_rng(3)
    middle = rng.integers(-200, 200, (8, 10))
    labels = rng.integers(0, 8, 3000)
    points = middle[labels] + rng.integers(-9, 10, (3000, 10))
    tree = Gnat.build(np.arange(3000), labels, points, leaf=16)
    tree = Gnat.from_bytes(tree.to_bytes())
    assert (tree.count > 0).sum() > 20 and tree.count.max() <= hard_negatives.FANOUT
    # Stored ranges hold the distances of all rows of the sibling's subtree.
    raised = np.column_stack([tree.points, np.sqrt(np.maximum(tree.largest - (tree.points**2).sum(1), 0))])
    for at in np.flatnonzero(tree.count):
        children = range(tree.first[at], tree.first[at] + tree.count[at])
        for seen_from, a in enumerate(children):
            for b in children:
                d = np.linalg.norm(raised[tree.begin[b] : tree.end[b]] - raised[tree.split[a]], axis=1)
                assert d.min() >= tree.near[b][seen_from] - 1e-3 and d.max() <= tree.far[b][seen_from] + 1e-3
    anchors = np.arange(0, 3000, 97)
    scores = points[anchors] @ points.T
    top = scores.max(axis=1)
    low = np.column_stack([top * 3 // 10, np.full(len(anchors), LEAST), np.ones(len(anchors))]).astype(np.int64)
    high = np.column_stack([top // 2, np.full(len(anchors), MOST), np.zeros(len(anchors))]).astype(np.int64)
    found = tree.search(points[anchors], anchors, labels[anchors], False, 7, low, high)
    for row, n in enumerate(anchors):
        for w in range(3):
            fits = [j for j in range(3000) if j != n and labels[j] != labels[n] and low[row, w] <= scores[row, j] <= high[row, w]]
            best = sorted(fits, key=lambda j: (-scores[row, j], j))[:7]
            ids, reached = found[row][w]
            assert ids.tolist() == best and reached.tolist() == scores[row, best].tolist()


def test_search_eliminates_most_leaves():
    """A window that holds few rows must not score the others."""
    rng = np.random.default_rng(5)
    middle = rng.integers(-400, 400, (30, 8))
    labels = np.repeat(np.arange(30), 200)
    points = middle[labels] + rng.integers(-3, 4, (6000, 8))
    labels = labels % 2
    tree = Gnat.build(np.arange(6000), labels, points, leaf=32)
    whole = np.array([[LEAST]]), np.array([[MOST]])
    tree.search(points[:1], np.array([0]), labels[:1], True, 5, *whole)
    assert 0 < tree.scored < 1500
    best = int((points[0] @ points.T).max())
    tree.search(points[:1], np.array([0]), labels[:1], False, 5, np.array([[best // 2]]), np.array([[best // 2 + 99]]))
    assert 0 < tree.scored < 3000


def test_query_of_hard_negatives_changes_labels(spark, tmp_path):
    rows = [(i * 10, v, label) for i, (_, v, label) in enumerate(vector_rows(150, seed=4))]
    spark.createDataFrame(as_floats(rows), VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = mined(queries()["op11_hard_negatives"](spark, str(tmp_path)))
    changed = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert found == brute_negatives(changed) and found


# ---- op12 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 17, 100, 1000, 4097])
def test_permutation_is_one_to_one_and_runs_backwards(total):
    permutation = sharding.Permutation(total, seed=7)
    places = permutation.places(np.arange(total))
    assert sorted(places) == list(range(total))
    assert (permutation.numbers(places) == np.arange(total)).all()


def test_permutation_of_very_many_rows():
    permutation = sharding.Permutation(2**61 + 12345)
    numbers = np.array([0, 1, 2**40, 2**61 + 12344], np.int64)
    places = permutation.places(numbers)
    assert (permutation.numbers(places) == numbers).all() and (places < 2**61 + 12345).all()
    other = sharding.Permutation(2**61 + 12345, seed=1).places(numbers)
    assert (other != places).any()


def test_permutation_shuffles():
    places = sharding.Permutation(10_000).places(np.arange(10_000))
    assert abs(np.corrcoef(np.arange(10_000), places)[0, 1]) < 0.05
    near = np.abs(np.diff(places)) < 100
    assert near.mean() < 0.04


def brute_shards(rows, shards=16):
    """``(id, text)`` rows; equal rows may swap, so the result is a multiset."""
    def key(row):
        text = (row[1] or "").encode()
        return (row[0] is not None, row[0] or 0, zlib.crc32(text), len(text))

    ordered = sorted(rows, key=key)
    places = sharding.Permutation(len(rows)).places(np.arange(len(rows))) if rows else []
    out = []
    for (i, text), place in zip(ordered, places):
        data = (text or "").encode()
        out.append((i, len(data) + 1, zlib.crc32(data), "rows", int(place) % shards, int(place) // shards, None))
    return sorted(out, key=str)


AWKWARD = [
    (3, "aa"), (3, "aa"), (3, "ab"), (None, "x"), (None, None), (1, None), (1, ""), (2, "ü" * 5000), (-4, "z"), (9, "aa"),
]


@pytest.mark.parametrize("rows", [AWKWARD, [], [(5, "one")], [(7, "same")] * 300 + [(n, "t") for n in range(50)]])
def test_query_of_sharding(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, shard string")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["op12_sharding"](spark, str(tmp_path)).drop("row_number").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_shards(rows)
    counts = Counter(r.shard for r in found)
    assert not rows or max(counts.values()) - min(counts[n] for n in range(16)) <= 1


def test_written_shards_hold_every_document_in_slot_order(spark, tmp_path):
    rows = [(n, f"text {n}", "own") for n in range(203)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    assert sharding.write_shards(docs, f"{tmp_path}/shards", shards=4, file_rows=20) == 203
    seen = {}
    for shard in range(4):
        read = sharding.read_shard(spark, f"{tmp_path}/shards", shard).collect()
        by_slot = sorted((r.slot, r.file, tuple(r.document)) for r in read)
        assert [s for s, _, _ in by_slot] == list(range(len(read)))
        assert all(file == slot // 20 for slot, file, _ in by_slot)
        seen |= {(shard, slot): document for slot, _, document in by_slot}
    assert sorted(seen.values()) == rows
    # Which document is at a place can be computed.
    permutation = sharding.Permutation(203)
    for (shard, slot), document in seen.items():
        assert document == rows[int(permutation.numbers([slot * 4 + shard])[0])]


# ---- op13 --------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    if len(a) + 1 != len(b):
        return False
    n = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[n:] == b[n + 1 :]


def brute_words(rows):
    counts = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_variants(rows):
    words = brute_words(rows)
    forms, partners = {}, defaultdict(list)
    names = sorted(words)
    for n, a in enumerate(names):
        for b in names[n + 1 :]:
            if near(a, b):
                partners[a].append(b)
                partners[b].append(a)
    for word in words:
        best = min(partners[word], key=lambda p: (-words[p], p), default=None)
        forms[word] = best if best is not None and words[best] >= 10 * words[word] else None
    out = []
    for word, n in words.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        form = forms[word]
        out.append((word, form, root, n, len(partners[word]), words[form] if form else None))
    return sorted(out, key=str)


def variant_rows(seed=0):
    rng = random.Random(seed)
    letters = "abcdeÀéßÿ×"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(60)]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(150):
            w = list(rng.choice(stems))
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(letters + "A")
            words.append("".join(w))
        rows.append((doc if doc % 9 else None, rng.choice(" .,1\n").join(words)))
    frequent = "understanding " * 500 + "understandings " * 40 + "understandngs " * 3 + "undrstandngs undrstandngs "
    rows += [(211, frequent), (100, "Understanding UNDERSTANDING"), (101, None), (102, ""), (103, "a" * 3_000 + " "), (103, "a" * 2_999)]
    rows += [(104, ("a" * 3_000 + " ") * 2 + ("a" * 2_999 + " ") * 3)]
    return rows


@pytest.mark.parametrize(("block", "short_list"), [(4096, 128), (16, 5)])
def test_spelling_variants_are_those_of_brute_force(spark, block, short_list):
    rows = variant_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    found = spelling_variants.spelling_variants(docs, block=block, short_list=short_list).collect()
    expected = brute_variants(rows)
    assert sorted((tuple(r) for r in found), key=str) == expected
    assert sum(r[1] is not None for r in expected) > 10
    # Chains of more than one form are followed to the end.
    assert any(r[1] is not None and r[2] != r[1] for r in expected)


def test_query_of_spelling_variants(spark, tmp_path):
    rows = variant_rows(3)
    schema = "doc_id long, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["op13_spelling_variants"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_variants(rows)


def test_spelling_variants_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants.spelling_variants(docs).collect() == []


def test_gram_numbers_are_their_letters():
    letters = np.array([[1, 97, 98, 99, 2], [1, 97, 98, 255, 2]], np.uint8)
    codes = gram_codes(letters, 3)
    assert codes.shape == (2, 3) and codes[0, 0] == codes[1, 0] and codes[0, 1] != codes[1, 1]
    assert len(set(codes.ravel()) | set(gram_codes(letters, 2).ravel())) == 5 + 6 - 0


def test_grams_grow_while_frequent_and_bound_what_an_edit_changes():
    def table(word):
        data = word.encode("latin-1")
        return Words(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([len(data)])).table(
            np.zeros(1, np.int64), len(data), marks=True
        )

    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(7, 12))) for _ in range(400)]
    counted = Counter()
    for word in words:
        for q in range(2, 6):
            counted.update(set(gram_codes(table(word), q)[0].tolist()))
    frequent = {c: n for c, n in counted.items() if n > 20}
    dictionary = Dictionary(np.array(list(frequent)), np.array(list(frequent.values())))
    for word in words[:60]:
        codes, sizes, counts = dictionary.grams(table(word))
        for place, (code, size, count) in enumerate(zip(codes[0], sizes[0], counts[0])):
            for q in range(2, size):
                assert int(gram_codes(table(word), q)[0, place]) in frequent
            assert count == frequent.get(int(code), 0)
            assert count == 0 or size == 5 or place + size == len(word) + 2
        bound = int(Dictionary.affected(sizes, len(word) + 2)[0])
        cover = [sum(p <= x < p + s for p, s in enumerate(sizes[0])) for x in range(len(word) + 2)]
        assert bound == max(cover)
        at = rng.randrange(len(word))
        for edited in (word[:at] + word[at + 1 :], word[:at] + "x" + word[at + 1 :], word[:at] + "x" + word[at:]):
            left = Counter(codes[0].tolist()) - Counter(dictionary.grams(table(edited))[0][0].tolist())
            assert sum(left.values()) <= bound


def test_each_near_pair_comes_once(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(7, 10))) for _ in range(500)})
    df = spark.createDataFrame([(bytearray(w.encode()), n + 2) for n, w in enumerate(words)], "word binary, n long")
    found = [(bytes(r.word).decode(), bytes(r.near).decode()) for r in near_words(df, block=16, short_list=10).collect()]
    expected = {(a, b) for a in words for b in words if near(a, b)}
    assert len(found) == len(set(found)) and set(found) == expected
