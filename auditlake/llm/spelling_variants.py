"""Spelling variants: words one edit apart, found with an index of variable-length grams.

Words are runs of Latin letters, all below code point 256, so a word is one byte per letter. Each is put
between a begin and an end mark, and a gram starts at each of its places: it begins with ``Q_MIN`` letters and
grows while it is frequent, up to ``Q_MAX``. The dictionary that decides this is pruned by frequency: it
holds the grams that more words have than a threshold, counted over all words; what lies below a rare gram
is never stored. So a gram is the shortest rare one at its place, and its posting list is short.

Whether a gram is in a word depends on its own letters only. An edit at some place hence changes exactly the
grams that cover the place; the largest number of grams over one place is the word's bound of affected
grams. A near word has all other grams, before the edit at the same distance from the begin mark, after it
from the end mark. So of a word's grams, the ``bound + 1`` rarest contain one that a near word has too, and it
is among the near word's ``bound + 1`` rarest: only these are posted, and these short lists are merged by
Spark's exchange. All other lists are long and are not merged: the pairs that meet in a short list look up
their common grams directly, and those with fewer than the larger of both words' least numbers of common
grams are dropped. The rest is verified letter by letter. With a begin and an end mark, words of seven letters
share at least three grams with any near word.

Scale: a list below the threshold is one task's work; longer lists, whose length the dictionary knows, are
dealt to blocks, and pairs of blocks go to tasks of their own. Nothing but near pairs is emitted, each
once: in the rarest list that both words post to. A letter run of any length is handled; pairs are compared
in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import materialize, text_or_empty

LETTERS = "A-Za-z\\u00C0-\\u00FF"
MIN_LETTERS, MIN_OCCURRENCES, FORM_RATIO = 7, 2, 10
TYPO_RATE = 31
Q_MIN, Q_MAX = 2, 5
BEGIN, END = 1, 2
# A list is short up to the threshold: the larger of these two.
SHORT_LIST, DICTIONARY = 128, 1 << 18
BLOCK = 4096
PAIRS_AT_ONCE, CELLS_AT_ONCE = 1 << 18, 1 << 22
LATIN = "ISO-8859-1"


# ---- Words -------------------------------------------------------------------------------------


def count_words(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(word, n)``: words of at least 7 letters that occur twice or more, with their number.

    A run whose number ``crc32("<id>:<run>")`` 31 divides loses one letter, at that number modulo its
    length. Only A-Z are lower-cased. A null text has no words, a null identifier counts as empty.
    """
    run = F.col("run")
    # Lower-casing is by letter table only where a letter beyond ASCII could change too.
    lowered = F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(
        F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
    # Losing a letter never makes a short run long enough, so short runs are not even extracted.
    runs = F.regexp_extract_all(text_or_empty(text), F.lit(f"([{LETTERS}]{{{MIN_LETTERS},}}+)"), F.lit(1))
    named = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    lost = (F.col("h") % F.char_length("run")).cast("int")
    return (
        docs.select(F.col(id).alias("id"), F.explode(runs).alias("run"))
        .select("id", lowered.alias("run"))
        .select("run", F.crc32(named).alias("h"))
        .select(
            F.when(
                F.col("h") % TYPO_RATE == 0,
                F.concat(F.substring("run", F.lit(1), lost), F.substring("run", lost + 2, F.char_length("run"))),
            )
            .otherwise(F.col("run"))
            .alias("word")
        )
        .where(F.char_length("word") >= MIN_LETTERS)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= MIN_OCCURRENCES)
    )


class Words:
    """Many words as bytes in one array."""

    def __init__(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.letters, self.starts, self.lengths = letters, starts, lengths

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Words:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = column.cast(pa.large_binary())
        _, offsets, letters = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
        letters = np.frombuffer(letters, np.uint8) if letters else np.empty(0, np.uint8)
        return cls(letters, ends[:-1], np.diff(ends))

    def same_length(self) -> Iterator[tuple[int, np.ndarray]]:
        """``(length, rows)`` in slices whose letters fit in a bounded table."""
        for length in np.unique(self.lengths):
            rows = np.flatnonzero(self.lengths == length)
            step = max(1, CELLS_AT_ONCE // int(length + 2))
            for at in range(0, len(rows), step):
                yield int(length), rows[at : at + step]

    def table(self, rows: np.ndarray, length: int, marks: bool = False) -> np.ndarray:
        """Letters of words of one length, one word a row."""
        inside = self.letters[self.starts[rows][:, None] + np.arange(length)]
        if not marks:
            return inside
        side = np.ones((len(rows), 1), np.uint8)
        return np.hstack([side * BEGIN, inside, side * END]).astype(np.uint8)


# ---- Grams -------------------------------------------------------------------------------------


def gram_codes(letters: np.ndarray, q: int) -> np.ndarray:
    """Numbers of all grams of ``q`` letters, one column per place; different grams have different numbers."""
    places = letters.shape[1] - q + 1
    codes = np.full((len(letters), places), q, dtype=np.int64)
    for n in range(q):
        codes = (codes << 8) | letters[:, n : n + places]
    return codes


class Dictionary:
    """The frequent grams and how many words have them."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], counts[order]

    def frequency(self, codes: np.ndarray) -> np.ndarray:
        """Words with each gram, 0 for grams that are not frequent."""
        if not len(self.codes):
            return np.zeros(codes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.counts[at], 0)

    def grams(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(codes, sizes, frequencies)`` of the gram at each place of the marked words."""
        codes = gram_codes(letters, Q_MIN)
        sizes = np.full(codes.shape, Q_MIN, np.int64)
        counts = self.frequency(codes)
        for q in range(Q_MIN + 1, Q_MAX + 1):
            longer = gram_codes(letters, q)
            grows = (counts[:, : longer.shape[1]] > 0) & (sizes[:, : longer.shape[1]] == q - 1)
            rows, places = np.nonzero(grows)
            codes[rows, places] = longer[rows, places]
            sizes[rows, places] = q
            counts[rows, places] = self.frequency(longer[rows, places])
        return codes, sizes, counts

    @staticmethod
    def affected(sizes: np.ndarray, width: int) -> np.ndarray:
        """Per word, the largest number of its grams that one edit can change: those over one place."""
        # A gram begins at every place but the last; how many ended before, is counted.
        ends = np.arange(sizes.shape[1]) + sizes + np.arange(len(sizes))[:, None] * (width + 1)
        ended = np.bincount(ends.ravel(), minlength=len(sizes) * (width + 1)).reshape(-1, width + 1)
        begun = np.minimum(np.arange(width) + 1, sizes.shape[1])
        return (begun - ended.cumsum(axis=1)[:, :width]).max(axis=1)

    def posted(self, letters: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(codes, sizes, counts, ranks, bounds)``; a gram is posted if its rank is at most the bound.

        Ranks order the grams of a word from rare to frequent: by number of words where they are frequent,
        then by code.
        """
        codes, sizes, counts = self.grams(letters)
        order = np.lexsort((codes, counts), axis=1)
        ranks = np.empty_like(order)
        np.put_along_axis(ranks, order, np.arange(order.shape[1])[None, :], axis=1)
        return codes, sizes, counts, ranks, self.affected(sizes, letters.shape[1])


def build_dictionary(words: DataFrame, short_list: int = SHORT_LIST, size: int = DICTIONARY) -> Dictionary:
    """Frequent grams of all words.

    The threshold is a share of all gram places, so at most ``size`` grams of each length pass it: the
    dictionary has a fixed bound whatever the number of words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Words.of(batch.column(0))
            for length, rows in found.same_length():
                letters = found.table(rows, length, marks=True)
                for q in range(Q_MIN, Q_MAX + 1):
                    # Once per word, however often the word repeats a gram: lists hold words.
                    codes = np.sort(gram_codes(letters, q), axis=1)
                    fresh = np.ones(codes.shape, bool)
                    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
                    codes, counts = np.unique(codes[fresh], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])

    counts = (
        words.select("word").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    )
    places = words.agg(F.sum(F.octet_length("word") + 1)).first()[0] or 0
    threshold = max(short_list, -(-int(places) // size))
    frequent = counts.where(F.col("n") > threshold).toArrow()
    return Dictionary(frequent["code"].to_numpy(), frequent["n"].to_numpy())


# ---- Lists -------------------------------------------------------------------------------------


def _blocks_of(counts: np.ndarray, block: int) -> np.ndarray:
    return np.maximum(1, -(-counts // block))


def post(words: DataFrame, dictionary: Dictionary, block: int = BLOCK) -> DataFrame:
    """``(code, first, second, mine, word, n)``: words in the lists of their rarest grams.

    Long lists are cut into blocks by a hash of the word; ``first <= second`` is the pair of blocks that
    a task compares, and ``mine`` the block of the word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Words.of(batch.column(0))
            for length, rows in found.same_length():
                codes, _, counts, ranks, bounds = dictionary.posted(found.table(rows, length, marks=True))
                at, place = np.nonzero(ranks <= bounds[:, None])
                code, blocks = codes[at, place], _blocks_of(counts[at, place], block)
                # A gram at two places of a word is one posting.
                order = np.lexsort((code, at))
                at, code, blocks = at[order], code[order], blocks[order]
                once = np.ones(len(at), bool)
                once[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1])
                at, code, blocks = at[once], code[once], blocks[once]
                hashed = batch.column(2).to_numpy()[rows]
                mine = hashed[at] % blocks
                each = np.repeat(np.arange(len(at)), blocks)
                other = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                taken = pa.array(rows[at[each]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(code[each]),
                        pa.array(np.minimum(mine[each], other).astype(np.int32)),
                        pa.array(np.maximum(mine[each], other).astype(np.int32)),
                        pa.array(mine[each].astype(np.int32)),
                        batch.column(0).take(taken),
                        batch.column(1).take(taken),
                    ],
                    ["code", "first", "second", "mine", "word", "n"],
                )

    fields = "code long, first int, second int, mine int, word binary, n long"
    hashed = F.pmod(F.xxhash64("word"), F.lit(1 << 31)).alias("hash")
    return words.select("word", "n", hashed).mapInArrow(run, fields)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row and each number of its range, in slices of bounded size."""
    counts = np.maximum(ends - starts, 0)
    cuts = np.cumsum(counts)
    at = 0
    while at < len(counts):
        stop = max(at + 1, int(np.searchsorted(cuts, (cuts[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        mine = counts[at:stop]
        rows = np.repeat(np.arange(at, stop), mine)
        yield rows, starts[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(mine) - mine, mine)
        at = stop


def near_in_lists(
    dictionary: Dictionary, lists: np.ndarray, mine: np.ndarray, apart: np.ndarray, codes: np.ndarray, words: Words
) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``(a, b)`` of all near pairs whose rarest common posted gram is the one of their list.

    ``lists`` numbers the list of every row, ``codes`` is the list's gram. Where ``apart`` only rows of
    different blocks ``mine`` are compared, as pairs of one block are the work of another task.
    """
    # All grams of the rows, flat: by row and place.
    sizes = words.lengths + 1
    first = np.cumsum(sizes) - sizes
    grams = np.empty(int(sizes.sum()), np.int64)
    counts, posted = np.empty_like(grams), np.empty(len(grams), bool)
    least = np.empty(len(sizes), np.int64)
    for length, rows in words.same_length():
        found, _, often, ranks, bounds = dictionary.posted(words.table(rows, length, marks=True))
        into = first[rows][:, None] + np.arange(length + 1)
        grams[into], counts[into], posted[into] = found, often, ranks <= bounds[:, None]
        least[rows] = length + 1 - bounds

    # One entry per place of the list's gram in a word, sorted by list, length and place.
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    entry = np.flatnonzero((grams == codes[row_of]) & posted)
    row = row_of[entry]
    place = entry - first[row]
    span = int(words.lengths.max(initial=0)) + 4

    def key(lists, lengths, places):
        return (lists * span + lengths) * span + places

    keys = key(lists[row], words.lengths[row], place)
    order = np.argsort(keys, kind="stable")
    keys, row, place = keys[order], row[order], place[order]
    length = words.lengths[row]

    def sought(longer: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        wanted = key(lists[row], length + longer, place + shift)
        starts = np.searchsorted(keys, wanted, "left")
        if not longer:
            starts = np.maximum(starts, np.arange(len(keys)) + 1)
        return _ranges(starts, np.searchsorted(keys, wanted, "right"))

    pairs_a, pairs_b = [], []
    # The shared gram lies before the edit (same place from the begin) or after it (from the end).
    for longer, shift in ((0, 0), (1, 0), (1, 1)):
        for x, y in sought(longer, shift):
            a, b = row[x], row[y]
            kept = ~apart[a] | (mine[a] != mine[b])
            a, b = a[kept], b[kept]
            for size in np.unique(words.lengths[a]):
                here = words.lengths[a] == size
                step = max(1, CELLS_AT_ONCE // int(size + 2))
                whole_a, whole_b = a[here], b[here]
                for at in range(0, len(whole_a), step):
                    c, d = whole_a[at : at + step], whole_b[at : at + step]
                    places = np.arange(size + 1)
                    left = grams[first[c][:, None] + places]
                    same = left == grams[first[d][:, None] + places]
                    later = left == grams[first[d][:, None] + places + longer] if longer else same
                    enough = (same | later).sum(axis=1) >= np.maximum(least[c], least[d])
                    c, d = c[enough], d[enough]
                    near = _one_edit(words, c, d, int(size), longer)
                    pairs_a.append(c[near])
                    pairs_b.append(d[near])
    a = np.concatenate(pairs_a or [np.empty(0, np.int64)])
    b = np.concatenate(pairs_b or [np.empty(0, np.int64)])
    if not len(a):
        return a, b
    a, b = np.divmod(np.unique(a * len(sizes) + b), len(sizes))
    first_here = _is_first_list(grams, counts, posted, first, sizes, a, b, codes[a])
    return a[first_here], b[first_here]


def _one_edit(words: Words, a: np.ndarray, b: np.ndarray, length: int, longer: int) -> np.ndarray:
    left, right = words.table(a, length), words.table(b, length + longer)
    if not longer:
        return (left != right).sum(axis=1) == 1
    begin = np.cumprod(left == right[:, :length], axis=1).sum(axis=1)
    end = np.cumprod((left == right[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return begin + end >= length


def _is_first_list(grams, counts, posted, first, sizes, a, b, codes) -> np.ndarray:
    """Whether no rarer gram is posted by both words of a pair at places that fit.

    Pairs meet in every list where the gram's places fit; the same rule is applied here to all lists.
    """
    out = np.empty(len(a), bool)
    longer = sizes[b] - sizes[a]
    for size in np.unique(sizes[a]):
        for more in (0, 1):
            which = np.flatnonzero((sizes[a] == size) & (longer == more))
            step = max(1, CELLS_AT_ONCE // int(size + 2))
            for at in range(0, len(which), step):
                w = which[at : at + step]
                x = first[a[w]][:, None] + np.arange(size)
                y = first[b[w]][:, None] + np.arange(size)
                code, count = grams[x], counts[x]
                meets = (grams[y] == code) & posted[y]
                if more:
                    meets |= (grams[y + 1] == code) & posted[y + 1]
                meets &= posted[x]
                # Order of the lists: by words, then by code, as the ranks.
                here = codes[w][:, None]
                own = np.where(code == here, count, -1).max(axis=1)[:, None]
                rarer = (count < own) | ((count == own) & (code < here))
                out[w] = ~(meets & rarer).any(axis=1)
    return out


NEAR = "word binary, near binary, near_n long"


def near_words(words: DataFrame, block: int = BLOCK, short_list: int = SHORT_LIST, size: int = DICTIONARY) -> DataFrame:
    """``(word, near, near_n)`` of all pairs one edit apart, in both directions, each once.

    ``words`` are ``(word, n)`` with different binary words of at least 7 letters.
    """
    dictionary = build_dictionary(words, short_list, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = pa.concat_tables([rest, part]) if rest is not None else part
            group = [part[c].to_numpy() for c in ("code", "first", "second")]
            last = np.logical_and.reduce([g == g[-1] for g in group]) if len(part) else np.empty(0, bool)
            cut = int(last.argmax()) if len(last) else 0
            # The last list may go on in the next batch.
            rest = part.slice(cut)
            if cut:
                yield from merged(part.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from merged(rest)

    def merged(part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        code, one, two, mine = (part[c].to_numpy() for c in ("code", "first", "second", "mine"))
        starts = np.ones(len(code), bool)
        starts[1:] = (code[1:] != code[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        lists = np.cumsum(starts) - 1
        a, b = near_in_lists(dictionary, lists, mine, one != two, code, Words.of(part["word"]))
        both = np.concatenate([a, b]), np.concatenate([b, a])
        word, n = part["word"], part["n"]
        for at in range(0, len(both[0]), 8192):
            x, y = (pa.array(side[at : at + 8192]) for side in both)
            arrays = [word.take(x).combine_chunks(), word.take(y).combine_chunks(), n.take(y).combine_chunks()]
            yield from pa.table(arrays, ["word", "near", "near_n"]).to_batches()

    keys = ("code", "first", "second")
    return post(words, dictionary, block).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, NEAR)


# ---- Forms -------------------------------------------------------------------------------------


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """``(word, root)`` of the words that have a form, following forms to the last.

    A form is at least ten times as frequent as its word, so a chain has at most as many steps as ``most`` has
    digits, and each round doubles the steps that are done.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    steps = 1
    while steps < len(str(most)):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialize(
            roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        )
        steps *= 2
    return roots


def spelling_variants(
    docs: DataFrame, text: str = "text", id: str = "doc_id", block: int = BLOCK, short_list: int = SHORT_LIST
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of at least 7 letters that occurs twice or more.

    Near words differ by exactly one inserted, deleted or replaced letter. A word's form is the most
    frequent of them (ties: the first in code-point order) if it occurs at least ten times as often as
    the word; ``root`` follows forms to the last and is the word itself if it has none. Null and empty
    texts have no words; rows that repeat an identifier all count; a null identifier counts as empty text.
    Runs may be of any length. Other columns do not matter; an empty table gives no rows.
    """
    counted = count_words(docs, text, id)
    words = materialize(counted.select(F.encode("word", LATIN).alias("word"), "n"))
    # The first in code-point order of the most frequent ones: the least of (-n, word).
    found = near_words(words, block, short_list).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("top")
    )
    top_n = -F.col("top.minus_n")
    is_form = top_n >= FORM_RATIO * F.col("n")
    table = materialize(
        words.join(found, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("top.near")).alias("form"),
            F.when(is_form, top_n).alias("form_n"),
        )
    )
    most = table.agg(F.max("n")).first()[0] or 1
    roots = _roots(table.where(F.col("form").isNotNull()), int(most))

    def named(column: str) -> Column:
        return F.decode(column, LATIN).alias(column)

    return (
        table.join(roots, "word", "left")
        .withColumn("root", F.coalesce("root", "word"))
        .select(named("word"), named("form"), named("root"), "n", "n_near", "form_n")
    )
