"""Token ids from the ``tokenizers`` library at corpus speed.

The library's model does the encoding, word by word; what is saved is repeated work. A text is cut at
places where the tokenizer's own splitting rule always cuts, and the ids of pieces seen lately are
remembered in bounded tables that a Python worker keeps from task to task. Where white space is dropped,
Arrow cuts a whole batch of texts, and each of its different words is looked up once. Texts outside the simple
case (special tokens, unusual white space) are found a batch at a time and go to the library whole, and
pieces with characters beyond Latin-1 go to it piece by piece, so the ids are the library's in every case.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Limits of either half of the tables of remembered pieces and words, to bound a worker's memory.
PIECES, WORDS = 250_000, 100_000
# Words in a table of Arrow arrays, and the bytes beyond which a word is not remembered.
KNOWN, LONGEST = 600_000, 64

# The splitting rules of both tokenizers within Latin-1.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \x85\xa0"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_SPLIT = re.compile(
    rf"{_CONTRACTIONS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
WORD_SPLIT = re.compile(rf"{_CONTRACTIONS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")

BEYOND_LATIN = re.compile(r"[^\x00-\xff]")
NOT_LATIN = r"[^\x{0}-\x{ff}]"
SEPARATORS = re.compile(r"[\x1c-\x1f]")
# White space but space and line feed; a space inside a run of white space that does not end right after it.
ODD_SPACE = "[" + "".join(rf"\x{{{n:x}}}" for n in range(0x3001) if chr(n).isspace() and chr(n) not in " \n") + "]"
INNER_SPACE = r"[ \n] (?:[ \n]|\z)"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = byte_alphabet()


def in_alphabet(word: str) -> str:
    """A word in the characters of a byte-level vocabulary."""
    if word.isascii() and word.isprintable():
        return word.replace(" ", _ALPHABET[ord(" ")])
    return "".join([_ALPHABET[b] for b in word.encode("utf-8", "surrogatepass")])


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


class Recent:
    """A table of what was seen lately: when ``size`` entries are new, the ones before them go."""

    def __init__(self, size: int):
        self.size = size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


def _ends(lengths: pa.Array | np.ndarray) -> np.ndarray:
    """Where things of these lengths that lie one behind the other begin, and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


class KnownWords:
    """Packed ids of words; different words are asked for many at once, and the ``size`` used last are kept.

    The table is two Arrow arrays, which take a fraction of the memory of Python's strings. Every question
    costs a pass over it, so that it pays for questions of many words.
    """

    def __init__(self, size: int, encode: Callable[[str], bytes]):
        self.size, self.encode = size, encode
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def ids_of(self, words: pa.Array) -> pa.Array:
        """Packed ids of every one of ``words``, which are all different."""
        # The table is looked up among the words asked for: they are fewer, and Arrow makes its hash table of them.
        place = pc.index_in(self.words, value_set=words)
        unused = place.is_null()
        at = np.full(len(words), -1, dtype=np.int64)
        at[place.drop_null().to_numpy()] = np.flatnonzero(~unused.to_numpy(zero_copy_only=False))
        unknown = at < 0
        new = [self.encode(w) for w in words.filter(pa.array(unknown)).to_numpy(zero_copy_only=False)]
        at[unknown] = np.arange(len(self.words), len(self.words) + len(new))
        found = pa.concat_arrays([self.ids, pa.array(new, pa.large_binary())]).take(pa.array(at))

        short = pc.less_equal(pc.binary_length(words), LONGEST)
        self.words = pa.concat_arrays([words.filter(short), self.words.filter(unused)])[: self.size]
        self.ids = pa.concat_arrays([found.filter(short), self.ids.filter(unused)])[: self.size]
        return found


def ids_of_texts(
    texts: pa.Array, odd: str, plain: Callable[[str], bytes], whole: Callable[[str], bytes]
) -> list[bytes]:
    """Packed ids of every text (null: empty): by ``whole`` where ``odd`` matches, else by ``plain``."""
    texts = pc.fill_null(texts, "")
    rows = zip(texts.to_pylist(), pc.match_substring_regex(texts, odd).to_pylist(), strict=True)
    return [whole(text) if is_odd else plain(text) for text, is_odd in rows]


class CorpusEncoder:
    """Encodes texts to packed ids with ``add_special_tokens=False``.

    ``kind`` is ``"byte"`` for a byte-level vocabulary whose words carry their leading space, or
    ``"word"`` for one that lower-cases and drops white space.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.words = Recent(PIECES), Recent(WORDS)
        self.known = KnownWords(KNOWN, self._new_key)
        self.odd = "|".join([*special, *{"byte": (ODD_SPACE, INNER_SPACE), "word": (SEPARATORS.pattern,)}[kind]])
        self.lower = kind == "word"

    def encode_texts(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of every text of a batch."""
        return self._word_texts(texts) if self.lower else ids_of_texts(texts, self.odd, self._byte_text, self.whole)

    def encode(self, text: str) -> bytes:
        """Packed ids of one text."""
        return self.encode_texts(pa.array([text], pa.string()))[0]

    def whole(self, text: str) -> bytes:
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _new_word(self, word: str) -> bytes:
        return pack([t.id for t in self.model.tokenize(in_alphabet(word))])

    def _word(self, word: str) -> bytes:
        # A word behind a space is also a piece, and the table of those has it already or from now on.
        at_space = len(word) > 1 and word[0] == " "
        table, key = (self.pieces, word[1:]) if at_space else (self.words, word)
        found = table.get(key)
        if found is None:
            found = self._new_word(word)
            table.put(key, found)
        return found

    def _ids(self, piece: str) -> bytes:
        if not piece.isascii() and BEYOND_LATIN.search(piece):
            return self.whole(piece)
        return b"".join([self._word(w) for w in BYTE_SPLIT.findall(piece)])

    def _spaced(self, piece: str) -> bytes:
        """The same of a piece behind a space, which its key does not repeat."""
        found = self.pieces.get(piece)
        if found is None:
            # Letters are one word for the splitting rule.
            simple = piece.isascii() and piece.isalpha()
            found = self._new_word(" " + piece) if simple else self._ids(" " + piece)
            self.pieces.put(piece, found)
        return found

    def _byte_text(self, text: str) -> bytes:
        """Cut before every space: the rule starts a word there unless white space goes on after it."""
        first, *rest = text.split(" ")
        known = self.pieces.new.get
        return self._ids(first) + b"".join([known(p) or self._spaced(p) for p in rest])

    def _new_key(self, key: str) -> bytes:
        """Ids of a lower-cased word, or of a piece with characters beyond Latin-1."""
        return self.whole(key) if BEYOND_LATIN.search(key) else self._new_word(key)

    def _word_texts(self, texts: pa.Array) -> list[bytes]:
        """Cut at white space, then the batch's different pieces into words, and look up its different words."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd)
        cut = pc.ascii_split_whitespace(pc.if_else(odd, "", texts))
        pieces = cut.flatten().dictionary_encode()
        words, words_of = self._words_of_pieces(pieces.dictionary)

        # A text's pieces lie one behind the other, and so do a piece's words and a word's ids.
        listed = words_of.take(pieces.indices)
        ids = self.known.ids_of(words).take(listed.flatten())
        firsts = _ends(pc.list_value_length(cut))
        firsts = _ends(pc.list_value_length(listed))[firsts]
        firsts = _ends(pc.binary_length(ids))[firsts].tolist()
        packed = memoryview(ids.buffers()[2] or b"")
        found = [bytes(packed[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        for row in pc.indices_nonzero(odd).to_pylist():
            found[row] = self.whole(texts[row].as_py())
        return found

    @staticmethod
    def _words_of_pieces(pieces: pa.Array) -> tuple[pa.Array, pa.ListArray]:
        """The different words of all pieces, and for each piece the places of its words among them.

        Letters are one word for the splitting rule; a piece with characters beyond Latin-1 stays whole.
        """
        beyond = pc.match_substring_regex(pieces, NOT_LATIN)
        keys = pc.if_else(beyond, pieces, pc.utf8_lower(pieces))
        single = pc.or_(beyond, pc.utf8_is_alpha(keys)).to_numpy(zero_copy_only=False)
        mixed = [WORD_SPLIT.findall(k) for k in keys.filter(pa.array(~single)).to_numpy(zero_copy_only=False)]
        parts = [keys.filter(pa.array(single)), pa.array([w for ws in mixed for w in ws], pa.string())]
        words = pa.concat_arrays(parts).dictionary_encode()
        counts = np.ones(len(pieces), dtype=np.int64)
        counts[~single] = [len(ws) for ws in mixed]
        is_single = np.repeat(single, counts)
        places = np.empty(len(is_single), dtype=np.int32)
        places[is_single], places[~is_single] = np.split(words.indices.to_numpy(), [len(parts[0])])
        ends = pa.array(_ends(counts).astype(np.int32))
        return words.dictionary, pa.ListArray.from_arrays(ends, pa.array(places))


@lru_cache(maxsize=4)
def corpus_encoder(path: str, kind: str) -> CorpusEncoder:
    """The encoder of this worker, with the pieces of earlier tasks."""
    return CorpusEncoder(path, kind)
