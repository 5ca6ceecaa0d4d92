"""BPE encoding and decoding with a tokenization automaton.

The automaton reads token labels; its states are "the last token read", and it accepts exactly the
token sequences that BPE produces. It is compiled from the merge list by one gadget per merge, in rank
order. It starts as one state with a loop for every base symbol. The gadget of ``a b -> c``

1. copies the state behind ``b`` as the one behind ``c``,
2. takes the arc ``b`` out of the state behind ``a``: after this merge ``a`` is never followed by ``b``. For
   ``a a -> c`` the copy of step 1 still has it, because ``a a a`` becomes ``c a``,
3. lays an arc ``c`` beside every arc ``a`` that there is now.

Where the arc ``b`` behind ``a`` is gone already, the merge can never fire; it gets no gadget, and its
token, unless another merge makes it, is never read.

A gadget touches one state and lays arcs that follow from older ones, so the automaton is kept as its
list of gadgets: ``arc(t, u)`` follows the gadgets back from ``(t, u)`` until one has removed the arc or
base symbols are left, and the answer enters the transition table. The full table would have the
square of the vocabulary; only arcs that a text asks for are filled in.

Encoding a pre-split word is a walk: at each place the longest label that continues the word along an
arc is taken, and a place from which no walk ends is left for good. All walks that reach a place end in
the same state, because a prefix has one BPE tokenization, so each place is left at most once. Decoding
emits the labels of the arcs.

Words are independent, so documents are encoded where they lie: no shuffle, and memory per worker is
the gadget list plus bounded tables of transitions and words.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import in_slices, text_or_empty
from auditlake.llm.tokenizer import (
    BEYOND_LATIN,
    SEPARATORS,
    WORD_SPLIT,
    Recent,
    ids_of_texts,
    in_alphabet,
    pack,
)

# Limits of the tables a worker keeps, of pieces and words of either half.
ARCS, PIECES, WORDS = 300_000, 200_000, 200_000
END = "\0"
FIRST_MERGES = 1 << 60  # above every rank


class MergeAutomaton:
    """The automaton of a merge list; ``suffix`` marks the last symbol of a word (may be empty)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.labels = {i: token for token, i in vocab.items()}
        size = max(vocab.values(), default=-1) + 1
        self.rank = [-1] * size
        self.left, self.right = [0] * size, [0] * size
        self.removed: dict[int, int] = {}
        self.unmade: set[int] = set()
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        # Labels by the text they cover; END stands for the end of a word.
        # Beginnings of such texts that are none themselves have -1.
        self.spelled: dict[str, int] = {}
        for token, i in vocab.items():
            if i in self.unmade:
                continue
            if suffix and token.endswith(suffix) and len(token) > len(suffix):
                token = token[: -len(suffix)] + END
            for n in range(1, len(token)):
                self.spelled.setdefault(token[:n], -1)
            self.spelled[token] = i
        self.arcs: dict[int, bool] = {}

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        if self.rank[c] >= 0:
            raise ValueError(f"two merges make {self.labels[c]!r}")
        if a in self.unmade or b in self.unmade or not self._arc(a, b):
            self.unmade.add(c)
            return
        self.unmade.discard(c)
        self.rank[c], self.left[c], self.right[c] = rank, a, b
        self.removed[a << 32 | b] = rank

    def arc(self, t: int, u: int) -> bool:
        """Whether the state behind ``t`` has an arc ``u``."""
        key = t << 32 | u
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._arc(t, u)
        return known

    def _arc(self, t: int, u: int) -> bool:
        rank, before = self.rank, FIRST_MERGES
        while True:
            gone = self.removed.get(t << 32 | u)
            if gone is not None and gone < before:
                return False
            if rank[t] > rank[u]:
                # The state behind t began as a copy of the one behind its right part.
                before, t = rank[t], self.right[t]
            elif rank[u] >= 0:
                # The arc u was laid beside its left part's; that gadget had removed its arc already.
                before, u = rank[u] + 1, self.left[u]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-split word."""
        if self.suffix:
            word += END
        size, known, arc, known_arc = len(word), self.spelled.get, self.arc, self.arcs.get
        if (token := known(word, -1)) >= 0:
            return [token]  # the longest label of all
        path: list[tuple[int, int, list[tuple[int, int]]]] = []
        left: set[int] = set()
        place, state = 0, -1
        while place < size:
            choices, end = [], place + 1
            while end <= size and (token := known(word[place:end])) is not None:
                if token >= 0:
                    choices.append((end, token))
                end += 1
            while True:
                step = None
                while choices:
                    end, token = choices.pop()
                    if end in left:
                        continue
                    if state < 0 or known_arc(state << 32 | token) or arc(state, token):
                        step = (end, token)
                        break
                if step:
                    path.append((place, state, choices))
                    place, state = step
                    break
                left.add(place)
                if not path:
                    raise ValueError(f"no tokenization of {word!r}")
                place, state, choices = path.pop()
        return [entry[1] for entry in path[1:]] + ([state] if path else [])

    def decode(self, ids: list[int]) -> list[str]:
        """The labels of the arcs."""
        return [self.labels[i] for i in ids]


class WordTokenizer:
    """A word-end BPE tokenizer file: its splitting rule with the automaton for the words.

    Special tokens in a text are single ids, as the file says. Normalising and splitting of characters
    beyond Latin-1 use the library's own rules; the ids never do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.automaton = MergeAutomaton(vocab, merges, spec["model"]["end_of_word_suffix"] or "")
        self.added = added
        self.at_added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        rules = Tokenizer.from_file(path)
        self.normalizer, self.splitter = rules.normalizer, rules.pre_tokenizer
        names = {i: token for token, i in vocab.items()} | {i: token for token, i in added.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)])
        self.pieces, self.words = Recent(PIECES), Recent(WORDS)
        self.odd = "|".join([*map(re.escape, added), SEPARATORS.pattern])

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = pack(self.automaton.encode(word))
            self.words.put(word, found)
        return found

    def _by_rules(self, text: str) -> bytes:
        split = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return b"".join([self._word(word) for word, _ in split])

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that is not among the newest."""
        found = self.pieces.get(piece)
        if found is None:
            if not piece.isascii() and BEYOND_LATIN.search(piece):
                found = self._by_rules(piece)
            else:
                found = b"".join([self._word(in_alphabet(w)) for w in WORD_SPLIT.findall(piece.lower())])
            self.pieces.put(piece, found)
        return found

    def _plain(self, text: str) -> bytes:
        known = self.pieces.new.get
        return b"".join([known(p) or self._piece(p) for p in text.split()])

    def _with_added(self, text: str) -> bytes:
        """Packed ids of a text with special tokens or with separators, part by part."""
        parts = self.at_added.split(text) if self.at_added else [text]
        return b"".join([pack([self.added[p]]) if p in self.added else self._by_rules(p) for p in parts])

    def encode_texts(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of every text of a batch."""
        return ids_of_texts(texts, self.odd, self._plain, self._with_added)

    def encode(self, text: str) -> bytes:
        """Packed ids of one text."""
        return self.encode_texts(pa.array([text], pa.string()))[0]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this worker; it keeps its tables from task to task."""
    return WordTokenizer(path)


def encode(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(id, ids)``: the token ids of every row.

    Null and empty texts have an empty list. Every row gives a row: repeated rows and null identifiers
    too. Other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in in_slices(batches):
            packed = tokenizer.encode_texts(batch.column(1))
            ends = np.cumsum([0, *[len(p) // 4 for p in packed]], dtype=np.int32)
            ids = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), ids)], ["id", "ids"]
            )

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the labels of ``ids``, joined by spaces (the file names no other decoder)."""
    keep = [c for c in rows.columns if c != "decoded"]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = word_tokenizer(path).names
        for batch in in_slices(batches):
            column = batch.column(keep.index(ids))
            labels = names.take(column.flatten())
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0))])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), labels)
            decoded = pc.binary_join(lists, " ")
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*keep, "decoded"])

    return rows.select(*keep).mapInArrow(run, f"{fields}, decoded string")
