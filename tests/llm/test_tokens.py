"""Tokenizing operators against the library, and round trips."""

import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from cases import awkward
from tokenizers import Tokenizer

from auditlake.llm import bpe_automaton, packing, plane_files, tokenizer
from auditlake.llm.bpe_automaton import MergeAutomaton, WordTokenizer
from auditlake.llm.tokenizer import CorpusEncoder, pack

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n", "  a", " a  b   c ", "a \n b\n\n c  ", "don't  I'LL we'Re", "x\t y", "é  \n \n ñ", "\x1c!\x1c a",
    "<|endoftext|> hi <|startoftext|>x", "Σας ΟΔΟΣ İ", "ab̈c é ́x", "日本語 test 123456 ½²", "a\xa0b c", "aaaa" * 50,
]


def texts():
    rng = random.Random(1)
    alphabet = "ab '\n\tsé½1! \x1c<|İ"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(3000)]


def ids_of(path):
    library = Tokenizer.from_file(path)
    return lambda t: library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path, kind", [(BYTE, "byte"), (WORD, "word")])
def test_corpus_encoder_equals_library(path, kind):
    encoder, ids = CorpusEncoder(path, kind), ids_of(path)
    assert [t for t in texts() if encoder.encode(t) != pack(ids(t))] == []


def test_corpus_encoder_equals_library_on_batches():
    encoder, ids, many = CorpusEncoder(WORD, "word"), ids_of(WORD), texts()
    expected = [pack(ids(t)) for t in many]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.array(["cut off", *many], kind)[1:]
        assert encoder.encode_texts(batch) == expected


def test_automaton_equals_library():
    tokenizer, ids = WordTokenizer(WORD), ids_of(WORD)
    assert [t for t in texts() if tokenizer.encode(t) != pack(ids(t))] == []


def by_merging(word, merges):
    tokens = list(word)
    for x, y in merges:
        at = 0
        while at < len(tokens) - 1:
            if (tokens[at], tokens[at + 1]) == (x, y):
                tokens[at : at + 2] = [x + y]
            at += 1
    return tokens


def random_merges(seed):
    """Merges of tokens made before, also such that can never fire."""
    rng = random.Random(seed)
    tokens, merges = ["a", "b", "c"], []
    while len(merges) < 9:
        x, y = rng.choice(tokens), rng.choice(tokens)
        if x + y not in tokens and len(x + y) < 7:
            merges.append((x, y))
            tokens.append(x + y)
    return merges


@pytest.mark.parametrize("seed", range(60))
def test_automaton_accepts_exactly_the_bpe_sequences(seed):
    """Small merge lists against plain merging, and the arcs against gadgets on an explicit automaton."""
    merges = random_merges(seed) if seed else [
        ("a", "b"), ("a", "a"), ("ab", "c"), ("b", "c"), ("aa", "ab"), ("c", "c"), ("abc", "c")
    ]
    vocab = {t: i for i, t in enumerate(["a", "b", "c", *[x + y for x, y in merges]])}
    automaton = MergeAutomaton(vocab, merges)

    # Explicit states: what may follow each token. The copy is taken before the arc goes.
    follows = {t: {"a", "b", "c"} for t in "abc"}
    begin = {"a", "b", "c"}
    for x, y in merges:
        if x not in follows or y not in follows or y not in follows[x]:
            continue
        follows[x + y] = set(follows[y])
        follows[x].discard(y)
        for state in [begin, *follows.values()]:
            if x in state:
                state.add(x + y)
    for t in follows:
        for u in follows:
            assert automaton.arc(vocab[t], vocab[u]) == (u in follows[t]), (t, u)
    rng = random.Random(seed)
    for _ in range(200):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        assert automaton.decode(automaton.encode(word)) == by_merging(word, merges), word
    assert automaton.encode("") == []


def test_encode_and_decode_frames(make_docs):
    rows, library = awkward(), Tokenizer.from_file(WORD)
    encoded = bpe_automaton.encode(make_docs(rows), WORD)
    found = bpe_automaton.decode(encoded, WORD).collect()
    expected = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((str(doc), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in found) == sorted(expected)
    assert bpe_automaton.encode(make_docs([]), WORD).collect() == []


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 1000])
def test_planes_round_trip(planes, size):
    ids = np.random.default_rng(size).integers(0, 2**32, size, dtype=np.uint32)
    for values in (ids, ids % 50_000, ids * 0):
        parts = plane_files.to_planes(values, planes)
        assert (plane_files.from_planes(parts, size, planes) == values).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_file_round_trip(planes):
    rng = np.random.default_rng(0)
    docs = [(i * 3, rng.integers(0, 49_000, n, dtype=np.uint32)) for i, n in enumerate([0, 5, 64, 200, 1, 0, 63])]
    parts, index = plane_files.file_bytes(((i, x.tobytes()) for i, x in docs), planes, 64)
    data = b"".join(parts)
    assert plane_files.read_index(data) == index and len(index["chunks"]) == -(-333 // 64)
    back = list(plane_files.read_documents(data))
    assert [i for i, _ in back] == [i for i, _ in docs]
    assert all((a == b).all() for (_, a), (_, b) in zip(back, docs, strict=True))
    with pytest.raises(ValueError):
        plane_files.read_index(data[:-3])


def test_id_files(spark, make_docs):
    rows, ids = [r for r in awkward() if r[0] is not None], ids_of(WORD)
    folder = plane_files.new_folder(spark)
    manifest = plane_files.write_id_files(make_docs(rows), WORD, folder, end_id=1, chunk_ids=256)
    found = sorted(plane_files.read_id_files(spark, manifest, folder).collect(), key=lambda r: r.start)
    at = 0
    for row, (doc, text) in zip(found, sorted(rows, key=lambda r: (r[0], r[1] or "")), strict=True):
        expected = [*ids(text or ""), 1]
        assert (row.doc_id, row.start, bytes(row.ids)) == (doc, at, pack(expected))
        at += len(expected)


def test_id_files_of_an_empty_table(spark, make_docs):
    folder = plane_files.new_folder(spark)
    manifest = plane_files.write_id_files(make_docs([]), WORD, folder, end_id=1)
    assert manifest.collect() == [] and plane_files.read_id_files(spark, manifest, folder).collect() == []


def brute_bins(lengths, capacity):
    """Fewest bins by trying every place of every piece."""
    best = [len(lengths)]

    def place(n, bins):
        if len(bins) >= best[0]:
            return
        if n == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[n] <= capacity:
                bins[i] += lengths[n]
                place(n + 1, bins)
                bins[i] -= lengths[n]
        place(n + 1, [*bins, lengths[n]])

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_tables():
    rng = random.Random(4)
    for _ in range(150):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(lengths, minlength=21)
        solution = packing.pack_lengths(counts, 20)
        used = np.zeros(21, int)
        for filling, times in solution:
            assert sum(filling) <= 20
            for length in filling:
                used[length] += times
        assert (used == counts).all()
        fewest = brute_bins(lengths, 20)
        assert packing.lower_bound(counts, 20) <= fewest <= packing.bins_of(solution)
        assert packing.bins_of(solution) <= min(fewest + 1, packing.bins_of(packing.best_fit(counts, 20)))
    assert packing.pack_lengths(np.zeros(21, int), 20) == []


def test_packing(spark, make_docs):
    rows, ids = awkward(), ids_of(BYTE)
    packed = packing.pack(make_docs(rows), BYTE, end_id=2, capacity=256).collect()
    by_sequence = defaultdict(list)
    pieces = defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        pieces[(r.doc_id, r.piece)].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    wanted = []
    for doc, text in rows:
        all_ids = [*ids(text or ""), 2]
        first = len(all_ids) % 256 or 256
        cuts = [0, *range(first, len(all_ids), 256), len(all_ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            raw = struct.pack(f"<{b - a}I", *all_ids[a:b])
            wanted.append((str(doc), n, a, b - a, zlib.crc32(raw), raw))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in packed) == sorted(wanted)
    total = sum(r.length for r in packed)
    assert len(by_sequence) <= -(-total // 256) + 2
    frame = spark.createDataFrame(packed)
    lengths = [len(r.ids) // 4 for r in packing.sequences(frame).collect()]
    assert sum(lengths) == total
    assert packing.pack(make_docs([]), BYTE, end_id=2).collect() == []


def test_frequent_words_stay_known_when_tables_are_full(monkeypatch):
    """Before, a full table was emptied, and frequent words were encoded again and again."""
    made = []
    monkeypatch.setattr(tokenizer, "PIECES", 40)
    monkeypatch.setattr(tokenizer, "WORDS", 40)
    monkeypatch.setattr(tokenizer, "in_alphabet", lambda w, f=tokenizer.in_alphabet: made.append(w) or f(w))
    encoder, ids = CorpusEncoder(BYTE, "byte"), ids_of(BYTE)
    texts = [f"Once lantern{n}x lantern harbour, {n * 7919}" for n in range(300)]
    assert [encoder.encode(t) for t in texts] == [pack(ids(t)) for t in texts]
    assert made.count(" lantern") == made.count(" harbour") == 1


def test_automaton_keeps_frequent_words_when_tables_are_full(monkeypatch):
    monkeypatch.setattr(bpe_automaton, "PIECES", 40)
    monkeypatch.setattr(bpe_automaton, "WORDS", 40)
    words, ids, made = WordTokenizer(WORD), ids_of(WORD), []
    walk = words.automaton.encode
    monkeypatch.setattr(words.automaton, "encode", lambda w: made.append(w) or walk(w))
    texts = [f"Lantern{n}x lantern harbour, {n * 7919}" for n in range(300)]
    assert [words.encode(t) for t in texts] == [pack(ids(t)) for t in texts]
    assert made.count("harbour") == 1


@pytest.mark.parametrize(
    "make", [lambda: CorpusEncoder(BYTE, "byte"), lambda: CorpusEncoder(WORD, "word"), lambda: WordTokenizer(WORD)]
)
def test_a_batch_of_odd_and_plain_texts_keeps_its_order(make):
    encoder = make()
    odd = ["", None, "a", " a  b ", "a\tb", "a \n b", "x\x1cy", "<|endoftext|> z", "a\u2003b", "a\x85b", "\n ", "end "]
    ids = ids_of(WORD if encoder.__class__ is WordTokenizer or encoder.lower else BYTE)
    assert encoder.encode_texts(pa.array(odd)) == [pack(ids(t or "")) for t in odd]


def test_different_words_of_a_batch_are_encoded_once(monkeypatch):
    """Before, every piece of every text was looked up by itself, and known pieces left no room for words."""
    asked, encode = [], tokenizer.KnownWords.ids_of
    monkeypatch.setattr(tokenizer.KnownWords, "ids_of", lambda s, w: asked.append(w.to_pylist()) or encode(s, w))
    encoder, ids = CorpusEncoder(WORD, "word"), ids_of(WORD)
    texts = ["The lantern, the LANTERN!", "Ünder the\xa0lantern it's 12", "日本 lantern, 日本", "\x1c lantern", "", None]
    texts = [t for n in range(20) for t in texts] + ["lantern" * 40]
    made = []
    monkeypatch.setattr(encoder.known, "encode", lambda w, f=encoder.known.encode: made.append(w) or f(w))
    for _ in range(2):
        assert encoder.encode_texts(pa.array(texts)) == [pack(ids(t or "")) for t in texts]
    words = ["the", "lantern", ",", "!", "ünder", "it", "'s", "1", "2", "日本", "lantern" * 40]
    assert [sorted(a) for a in asked] == [sorted(words)] * 2
    # What is too long to be remembered is encoded once a batch.
    assert sorted(made) == sorted([*words, words[-1]])


def test_known_words_keep_those_used_last():
    made = []
    known = tokenizer.KnownWords(3, lambda w: made.append(w) or w.encode() * 2)
    for words in (["a", "b"], ["a", "c", "d"], ["a", "e"], ["a", "b"], []):
        assert known.ids_of(pa.array(words, pa.string())).to_pylist() == [w.encode() * 2 for w in words]
    assert made == ["a", "b", "c", "d", "e", "b"] and known.words.to_pylist() == ["a", "b", "e"]


def test_arrow_sees_latin_letters_as_the_splitting_rule_does():
    latin = [chr(n) for n in range(256)]
    assert pc.utf8_lower(pa.array(latin)).to_pylist() == [c.lower() for c in latin]
    letters = [bool(re.match(f"[{tokenizer._L}]", c)) for c in latin]
    assert pc.utf8_is_alpha(pa.array(latin)).to_pylist() == letters
    beyond = pc.match_substring_regex(pa.array([*latin, "Ā", "日", "İ"]), tokenizer.NOT_LATIN)
    assert beyond.to_pylist() == [False] * 256 + [True] * 3


def test_text_slices_hold_every_row_once():
    texts = ["x" * n for n in (3, 3, 3, 50, 0, 0, 9, 1, 10)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["id", "text"]).slice(1)
    slices = [s.column(0).to_pylist() for s in plane_files.text_slices(batch, 1, 10)]
    assert slices == [[1, 2], [3], [4, 5, 6, 7], [8]]
    assert list(plane_files.text_slices(batch.slice(0, 0), 1, 10)) == []
