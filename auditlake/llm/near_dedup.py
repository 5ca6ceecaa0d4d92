"""MinHash near-dedup as an inverted join of signature coordinates.

A document's set are its distinct 2-word shingles; documents link when 100 * intersection is at least
80 * union, confirmed on the full sets. The search for pairs goes over signatures:

1. Every document gets ``COORDINATES`` MinHash values. Documents with equal sets are one class from here
   on, so thousands of copies are one row.
2. Classes that share no whole group of ``GROUPED`` coordinates with another class are left out: in a large
   table most texts share single values with others by chance, but hardly ever a group of them.
3. The other classes are posted under each (coordinate, value) pair. A pair that links agrees in at least
   ``MATCHES`` coordinates and in a group of them (a linked pair misses this with a probability below 1e-5
   at similarity 0.8 and far less above it). Values nobody shares are dropped.
   Prefix: with the values of each class in order of document frequency, two classes with ``MATCHES``
   common values have ``OVERLAP`` of them among their ``PREFIX`` rarest, so only those are merged.
   Frequent values are skipped; they count when signatures are compared.
4. Collisions are counted per pair over the prefix lists, pairs with fewer than ``OVERLAP`` fall away, and
   of the rest the full signatures must match in ``MATCHES`` places and then the sets in 80 hundredths.

**No list is expanded to all pairs.** In a first round each list is merged with one pivot only, the class
whose values are the most widely shared (the original of a group of near copies), which is linear. Links
found make components. The second round completes the search: in a list, pairs inside one component need
no look, so only classes outside the list's main component are merged with the rest. Where that is more
than ``GROUP_PAIRS`` pairs for one main component, as with many copies just below the limit around a
large group, both sides are compared block by block inside tasks, and only links leave them. Together
the rounds look at every pair of a list that could join two components.

Skewed lists are hot keys of joins with a plain exchange on either side, which Spark splits, and all
counts combine before their shuffles. Sets travel as compressed texts, which are a fraction of their
hashes, and only those of classes in a pair. Intermediate tables lie in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.anchors import BLOCK, Rolling, mix
from auditlake.llm.common import in_slices, materialize, release, text_or_empty, texts_of
from auditlake.llm.components import components

COORDINATES, MATCHES, OVERLAP = 64, 36, 4
PREFIX = COORDINATES - MATCHES + OVERLAP
# Coordinates a group; at similarity 0.8 a pair agrees in none of the groups with a probability of 3e-7.
GROUPED = 3
SIMILAR, OF = 80, 100
# Groups with more pairs than this to look at are compared in blocks of about so many classes, or of so
# many shingles if these are fewer classes.
GROUP_PAIRS, BLOCK_OUTSIDE, BLOCK_ALL, BLOCK_SHINGLES = 16_384, 512, 1024, 1 << 19
# Bits per identifier in a filter of rows, bits in a row of it, and rows at most (8 MB in all).
FILTER_BITS, FILTER_ROW, FILTER_ROWS = 16, 1 << 15, 2048

_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _long_word(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of one text: runs without ASCII white space, A-Z lower-cased."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]])))
    begin, end = edges[::2], edges[1::2]
    out = np.empty(len(begin), dtype=np.uint64)
    first = 0
    while first < len(begin):
        # Words up to a block's length at a time; a longer word by itself.
        last = int(np.searchsorted(end, begin[first] + BLOCK, side="right"))
        if last == first:
            out[first] = _long_word(data[begin[first] : end[first]].tobytes())
            first += 1
            continue
        origin = begin[first]
        rolling = Rolling(data[origin : end[last - 1]])
        out[first:last] = rolling.at(begin[first:last] - origin, end[first:last] - origin)
        first = last
    return out


def shingle_set(text: str) -> np.ndarray:
    """Sorted hashes of the distinct 2-word shingles; of the only word if there is one; else empty."""
    words = word_hashes(text)
    if len(words) < 2:
        return mix(words * np.uint64(0xD6E8FEB86659FD93))
    first, second = words[:-1], words[1:]
    return np.unique(mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(second)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set that is not empty, each as 32 mixed bits.

    The least values of large sets lie close together, so their leading bits agree by chance, the more
    often the more documents there are. Mixed from all 64 bits they agree only where the values do.
    """
    best = np.full(COORDINATES, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None] * _FACTORS + _SHIFTS
        best = np.minimum(best, part.min(axis=0))
    return (mix(best) >> np.uint64(32)).astype(np.uint32)


def _sketches(docs: DataFrame) -> DataFrame:
    """``(doc, n, digest, signature)`` of ``docs(doc, text)``; the signature as packed 32-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            number, digest, packed = [], [], []
            for text in texts_of(batch.column(1)):
                shingles = shingle_set(text)
                number.append(len(shingles))
                digest.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                packed.append(signature(shingles).tobytes() if len(shingles) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number, pa.int64()), pa.array(digest, pa.binary()), pa.array(packed, pa.binary())],
                ["doc", "n", "digest", "signature"],
            )

    return docs.select("doc", "text").mapInArrow(run, "doc long, n long, digest binary, signature binary")


def _bits(needed: DataFrame, name: str) -> tuple[DataFrame, int, Column]:
    """``(row, bits)``: a bit for every hash of the identifiers ``name`` of ``needed``; the number of rows; and
    the hash's place among the bits.

    Rows whose bit is not set are not needed; a few of the others are not either. The filter is at most
    ``FILTER_ROWS`` rows whatever the size of the tables; with more identifiers it lets more rows pass.
    """
    rows = min(FILTER_ROWS, needed.count() * FILTER_BITS // FILTER_ROW + 1)
    place = F.pmod(F.xxhash64(name), F.lit(rows * FILTER_ROW))
    bits = (
        needed.select(place.alias("place"))
        .groupBy(F.expr(f"place div {FILTER_ROW}").alias("row"))
        .agg(F.expr(f"bitmap_construct_agg(place % {FILTER_ROW})").alias("bits"))
    )
    return bits, rows, place


def _likely(rows: DataFrame, needed: DataFrame, name: str) -> DataFrame:
    """The rows whose identifier ``name`` has its bit among those of ``needed``, without a worker for it."""
    bits, _, place = _bits(needed, name)
    byte = F.expr(f"substring(bits, cast(place % {FILTER_ROW} div 8 as int) + 1, 1)")
    is_set = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr("shiftleft(1, cast(place % 8 as int))")) > 0
    return (
        rows.withColumn("place", place)
        .withColumn("row", F.expr(f"place div {FILTER_ROW}"))
        .join(F.broadcast(bits), "row")  # at most ``FILTER_ROWS`` rows of 4 KB
        .where(is_set)
        .select(*rows.columns)
    )


def _filter_of(needed: DataFrame, name: str = "doc") -> tuple[np.ndarray, Column]:
    """The bits of ``needed`` as packed bytes, and a hash's place among them."""
    bits, rows, place = _bits(needed, name)
    known = np.zeros((rows, FILTER_ROW // 8), dtype=np.uint8)
    for row in bits.collect():  # at most ``FILTER_ROWS`` rows of 4 KB
        known[row["row"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return known.reshape(-1), place


def _passed(batch: pa.RecordBatch, known: np.ndarray) -> pa.RecordBatch:
    """The rows whose place, the last column, has its bit set in the filter."""
    at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
    return batch.filter(pa.array((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))


def _grouped(classes: DataFrame) -> DataFrame:
    """``(rep, key)``: every class under each group of its coordinates, as one number."""
    groups = COORDINATES // GROUPED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(groups, dtype=np.uint64)
        for batch in in_slices(batches, 2048):
            rep = batch.column(0).to_numpy(zero_copy_only=False)
            if len(rep):
                packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32)
                values = packed.reshape(-1, COORDINATES)[:, : groups * GROUPED].astype(np.uint64)
                keys = np.tile(mix(place), (len(rep), 1))
                for k in range(GROUPED):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, k::GROUPED])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rep, groups)), pa.array(keys.reshape(-1).view(np.int64))], ["rep", "key"]
                )

    return classes.select("rep", "signature").mapInArrow(run, "rep long, key long")


def _able_to_link(classes: DataFrame) -> DataFrame:
    """``(rep)`` of the classes that share a whole group of coordinates with another class."""
    grouped = _grouped(classes)
    shared = materialize(
        grouped.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1).select("key")
    )
    return materialize(grouped.join(shared, "key", "left_semi").select("rep").distinct())


def _values(classes: DataFrame, able: DataFrame) -> DataFrame:
    """``(rep, n, key)``: every class of ``able(rep)``, and few others, under each of its (coordinate, value)
    pairs, as one number."""
    known, place = _filter_of(able, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in in_slices(batches, 2048):
            batch = _passed(batch, known)
            rep, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if len(rep):
                values = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32)
                keys = (values.reshape(-1, COORDINATES).astype(np.int64) | high).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rep, COORDINATES)), pa.array(np.repeat(n, COORDINATES)), pa.array(keys)],
                    ["rep", "n", "key"],
                )

    rows = classes.select("rep", "n", "signature", place.alias("place"))
    return rows.mapInArrow(run, "rep long, n long, key long")


def _postings(classes: DataFrame) -> DataFrame:
    """``(key, rep, n, spread)``: the prefix of every class that may link, without values of its own.

    ``spread`` adds up how many classes share each of the values of a class.
    """
    values = _values(classes, _able_to_link(classes))
    shared = materialize(
        values.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    )
    mine = (
        values.join(shared, "key")
        .groupBy("rep", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("values"))
    )
    # Values that nobody shares come first in the order and use up their part of the prefix.
    room = PREFIX - (COORDINATES - F.size("values"))
    return mine.where(room >= OVERLAP).select(
        "rep",
        "n",
        F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + v["df"]).alias("spread"),
        F.explode(F.slice("values", F.lit(1), room)["key"]).alias("key"),
    )


def _sizes_fit(n: str, m: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * OF >= F.greatest(n, m) * SIMILAR


def _set_of(packed: bytes) -> np.ndarray:
    """The shingles of a text that travelled compressed."""
    return shingle_set(zstandard.decompress(packed).decode("utf-8", "surrogatepass"))


def _full_texts(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc, signature, packed)`` of every class that is posted: its text compressed, which is smaller
    than its set.

    An identifier that comes with several texts has a row for each; a link of one of them is a link of
    the document.
    """
    needed = materialize(postings.select(F.col("rep").alias("doc")).distinct())
    known, place = _filter_of(needed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=6, write_checksum=False)
        for batch in in_slices(batches):
            batch = _passed(batch, known)
            raw = (text.encode("utf-8", "surrogatepass") for text in texts_of(batch.column(1)))
            packed = pa.array([compressor.compress(r) for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["doc", "packed"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            made = [_set_of(packed) for packed in batch.column(1).to_pylist()]
            filled = pa.array([len(m) > 0 for m in made], pa.bool_())
            signatures = pa.array([signature(m).tobytes() for m in made if len(m)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(filled), signatures, batch.column(1).filter(filled)],
                ["doc", "signature", "packed"],
            )

    # Compressed before the join, so that the join moves small rows however it is planned; texts that
    # the filter knows not to be needed are not moved at all.
    packed = docs.select("doc", "text", place.alias("place")).mapInArrow(pack, "doc long, packed binary")
    texts = packed.join(needed, "doc", "left_semi")
    return materialize(texts.mapInArrow(sign, "doc long, signature binary, packed binary"))


def _counted(pairs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` that collide in enough lists of the prefix."""
    return (
        pairs.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("collisions"))
        .where(F.col("collisions") >= OVERLAP)
        .select("a", "b")
    )


def _confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs whose signatures match often enough and whose full sets are similar.

    Signatures go first: they are a fraction of the sets, and most pairs end there. Of either, only rows
    that a filter knows to be in a pair are moved.
    """

    def sides(pairs: DataFrame, column: str) -> DataFrame:
        def side(name: str) -> DataFrame:
            rows = full.select(F.col("doc").alias(name), F.col(column).alias(f"{name}_{column}"))
            return _likely(rows, materialize(pairs.select(name).distinct()), name)

        joined = pairs.join(side("b"), "b").join(side("a"), "a")
        return joined.select("a", "b", f"a_{column}", f"b_{column}")

    def kept(rows: DataFrame, test: Callable[[bytes, bytes], bool]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches):
                columns = (batch.column(n).to_pylist() for n in (2, 3))
                mask = pa.array([test(a, b) for a, b in zip(*columns, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"]
                )

        return materialize(rows.mapInArrow(run, "a long, b long"))

    def matching(mine: bytes, theirs: bytes) -> bool:
        return int((np.frombuffer(mine, np.uint32) == np.frombuffer(theirs, np.uint32)).sum()) >= MATCHES

    def similar(left: bytes, right: bytes) -> bool:
        a, b = _set_of(left), _set_of(right)
        common = len(np.intersect1d(a, b, assume_unique=True))
        return OF * common >= SIMILAR * (len(a) + len(b) - common)

    return kept(sides(kept(sides(materialize(pairs), "signature"), matching), "packed"), similar)


def _pivot() -> Column:
    """A list's pivot: the most widely shared class, of several the least identifier."""
    return F.max(F.struct("spread", (-F.col("rep")).alias("minus"), "n")).alias("p")


def _of_pivot() -> list[Column]:
    return [(-F.col("p.minus")).alias("pivot"), F.col("p.n").alias("pivot_n")]


def _pivot_pairs(postings: DataFrame) -> DataFrame:
    """Every class of a list with the list's most widely shared class."""
    pivots = materialize(
        postings.groupBy("key")
        .agg(_pivot(), F.count(F.lit(1)).alias("c"))
        .where(F.col("c") > 1)
        .select("key", *_of_pivot())
    )
    return (
        postings.join(pivots, "key")
        .where((F.col("rep") != F.col("pivot")) & _sizes_fit("n", "pivot_n"))
        .select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    )


def _mixed_lists(postings: DataFrame, found: DataFrame) -> DataFrame:
    """Postings of lists that have several components, with ``component`` and the list's ``main`` one."""
    labelled = materialize(
        postings.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep")
        )
    )
    main = materialize(
        labelled.groupBy("key", "component")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("key")
        .agg(F.max(F.struct("c", "component")).alias("m"), F.count(F.lit(1)).alias("parts"))
        .where(F.col("parts") > 1)
        .select("key", F.col("m.component").alias("main"))
    )
    return materialize(labelled.join(main, "key"))


def _links_in_blocks(members: DataFrame, full: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between classes outside a main component and all classes of its lists, at least
    one for every two components that a class joins.

    ``members`` are ``(main, rep, component, outside, all, outside_n, all_n)`` with the numbers of classes
    and of shingles of either kind. Both sides are dealt to blocks of bounded size and every pair of
    blocks is compared in one task, so that a group sends each of its texts to a few blocks instead of to
    every partner.
    """
    texts = full.select(F.col("doc").alias("rep"), "signature", "packed")
    texts = texts.join(members.select("rep").distinct(), "rep", "left_semi")

    def blocks(classes: str, shingles: str, most: int) -> Column:
        return F.ceil(F.greatest(F.col(classes) / most, F.col(shingles) / BLOCK_SHINGLES)).cast("int")

    rows = (
        members.join(texts, "rep")
        .withColumn("x_blocks", blocks("outside", "outside_n", BLOCK_OUTSIDE))
        .withColumn("y_blocks", blocks("all", "all_n", BLOCK_ALL))
    )
    fields = ("main", "x", "y", "rep", "component", "signature", "packed")

    def dealt(rows: DataFrame, own: str, other: str, seed: int) -> DataFrame:
        place = F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(f"{own}_blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        return rows.withColumn(own, place).withColumn(other, every).select(*[F.col(c).alias(c) for c in fields])

    xs = dealt(rows.where(F.col("component") != F.col("main")), "x", "y", 1)
    ys = dealt(rows, "y", "x", 2)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            x, y = (t["rep"].to_numpy() for t in (left, right))
            x_part, y_part = (t["component"].to_numpy() for t in (left, right))
            y_out = y_part != right["main"].to_numpy()
            x_sig, y_sig = (
                np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint32).reshape(-1, COORDINATES)
                for t in (left, right)
            )
            y_sets = [_set_of(raw) for raw in right["packed"].to_pylist()]
            sizes = np.array([len(s) for s in y_sets])
            owner = np.repeat(np.arange(len(y)), sizes)
            pooled = np.concatenate(y_sets)
            order = np.argsort(pooled)
            pooled, owner = pooled[order], owner[order]
            for row, raw in enumerate(left["packed"].to_pylist()):
                wanted = (y_part != x_part[row]) & (~y_out | (x[row] < y))
                wanted &= (y_sig == x_sig[row]).sum(axis=1) >= MATCHES
                if not wanted.any():
                    continue
                mine = _set_of(raw)
                begin = np.searchsorted(pooled, mine)
                found = np.searchsorted(pooled, mine, side="right") - begin
                # The places begin, begin + 1, ... of every shingle, one run after the other.
                places = np.repeat(begin - np.cumsum(found) + found, found) + np.arange(found.sum())
                common = np.bincount(owner[places], minlength=len(y))
                linked = wanted & (OF * common >= SIMILAR * (sizes + len(mine) - common))
                # One link joins a component as well as many do.
                _, some = np.unique(y_part[linked], return_index=True)
                a += [int(x[row])] * len(some)
                b += y[linked][some].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return materialize(
        xs.groupBy("main", "x", "y").cogroup(ys.groupBy("main", "x", "y")).applyInArrow(compare, "a long, b long")
    )


def _crossing_links(postings: DataFrame, found: DataFrame, full: DataFrame) -> DataFrame:
    """The links between different components: by pairs in small groups, by blocks in large ones."""
    mixed = _mixed_lists(postings, found)
    members = materialize(mixed.select("main", "rep", "component", "n").distinct())
    is_outside = (F.col("component") != F.col("main")).cast("long")
    large = materialize(
        members.groupBy("main")
        .agg(
            F.sum(is_outside).alias("outside"),
            F.count(F.lit(1)).alias("all"),
            F.sum(is_outside * F.col("n")).alias("outside_n"),
            F.sum("n").alias("all_n"),
        )
        .where(F.col("outside") * F.col("all") > GROUP_PAIRS)
    )
    by_pairs = _confirmed(_counted(_crossing_pairs(mixed.join(large, "main", "left_anti"))), full)
    # Stored, so that its size is known where texts are looked up by it.
    of_large = materialize(members.drop("n").join(large, "main"))
    return by_pairs.unionByName(_links_in_blocks(of_large, full))


def _crossing_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs of a list in different components, by the classes outside its main component."""
    outside = mixed.where(F.col("component") != F.col("main")).select(
        "key",
        F.col("rep").alias("x"),
        F.col("n").alias("x_n"),
        F.col("component").alias("x_component"),
    )
    in_main = F.col("component") == F.col("main")
    return (
        outside.join(mixed, "key")
        .where(
            (F.col("component") != F.col("x_component"))
            & (in_main | (F.col("x") < F.col("rep")))
            & _sizes_fit("n", "x_n")
        )
        .select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b"))
    )


def near_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``.

    ``component_id`` is the least identifier reachable over links, the row's own included; ``kept`` says
    that it is the row's own. Null and empty texts, and texts of white space, have an empty set and no
    links. Texts of one word have that word as their set. Equal sets always link, so repeated rows share
    a component; rows without identifier stand alone with a null component and are kept. Other columns
    do not matter; an empty table gives no rows.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    known = rows.where(F.col("doc").isNotNull())
    sketches = materialize(_sketches(rows))
    classes = materialize(
        sketches.where((F.col("n") > 0) & F.col("doc").isNotNull())
        .groupBy("digest")
        .agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    )
    postings = materialize(_postings(classes))
    release(docs.sparkSession)
    full = _full_texts(postings, known)
    release(docs.sparkSession)
    links = _confirmed(_counted(_pivot_pairs(postings)), full)
    release(docs.sparkSession)
    found = components(links)
    rest = _crossing_links(postings, found, full)
    release(docs.sparkSession)
    found = materialize(components(links.unionByName(rest)))
    of_class = materialize(
        classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
            "digest", F.coalesce("component", "rep").alias("component")
        )
    )
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return (
        sketches.join(of_class, "digest", "left")
        .withColumn("component", F.when(F.col("doc").isNotNull(), component))
        .select(
            F.col("doc").alias(id),
            F.col("n").alias("n_shingles"),
            F.col("component").alias("component_id"),
            F.col("doc").eqNullSafe(F.col("component")).alias("kept"),
        )
    )
