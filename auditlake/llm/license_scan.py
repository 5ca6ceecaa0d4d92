"""License scan over a positional rare-token index.

The index holds licence notices as word positions. A file's licence words are looked up by rarity: the
document frequency of every notice word over the whole corpus gives its IDF, and each key phrase is
posted under its word of highest IDF only (``cc`` rather than ``by``). A file's words are matched with
these postings; each hit fixes the relative position of file and notice, all further words of the
phrase must lie at that shift, which verifies the mandatory key phrase, and the IDF mass of notice
words found at the same shift gives the score.

Every place of a phrase contains its rarest word, so looking up that word loses no place.

All of it is built-in functions on the row itself: the frequency count shuffles one row per notice word
and task, and the scan shuffles nothing, so neither a hot source nor a very long text matters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import text_or_empty

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HITS = "array<struct<label:string,base:boolean,start:bigint,length:int,coverage:double>>"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Notice:
    """A licence label, its mandatory key phrase, and the notice text around that phrase."""

    label: str
    phrase: str
    notice: str
    base: bool = False


# The base phrases with their labels come first, further licences follow.
NOTICES = (
    Notice("cc-by", "cc by", "licensed under cc by", base=True),
    Notice(
        "gpl",
        "general public license",
        "this work is licensed under the gnu general public license version 3",
        base=True,
    ),
    Notice("reserved", "all rights reserved", "all rights reserved", base=True),
    Notice("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license"),
    Notice("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    Notice("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    Notice("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    Notice("cc0", "cc0 1 0 universal", "dedicated to the public domain under cc0 1 0 universal"),
    Notice("isc", "permission to use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license"),
    Notice("mit", "mit license", "released under the mit license"),
    Notice("mpl-2.0", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    Notice("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """Words of a text, with A-Z lower-cased and all other characters as they are."""
    lower = F.translate(text, UPPER, UPPER.lower())
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def notice_words(notices: Sequence[Notice] = NOTICES) -> list[str]:
    """All words of the notices, sorted."""
    return sorted({w for n in notices for w in [*n.notice.split(), *n.phrase.split()]})


def word_idf(words: DataFrame, notices: Sequence[Notice] = NOTICES) -> dict[str, float]:
    """IDF of every notice word over all rows of ``words``: ``ln((rows + 1) / (rows with it + 1))``.

    The result has one number per notice word, whatever the size of the corpus.
    """
    vocabulary = notice_words(notices)
    seen = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    counted = (
        # The empty mark of every row counts the rows in the same pass.
        words.select(F.explode(F.concat(seen, _strings([""]))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    found = {row["word"]: row["n"] for row in counted}
    rows = found.get("", 0)
    return {w: math.log((rows + 1) / (found.get(w, 0) + 1)) for w in vocabulary}


def _find(text_words: list[str], phrase: list[str]) -> int:
    for at in range(len(text_words) - len(phrase) + 1):
        if text_words[at : at + len(phrase)] == phrase:
            return at
    raise ValueError(f"the notice lacks its key phrase {' '.join(phrase)!r}")


def _postings(notices: Sequence[Notice], idf: dict[str, float]) -> list[dict]:
    """One entry per notice: key phrase, the rarest word with its place, notice words with weights."""
    entries = []
    for notice in notices:
        phrase, text = notice.phrase.split(), notice.notice.split()
        rarest = max(range(len(phrase)), key=lambda i: (idf[phrase[i]], -i))
        entries.append(
            {
                "label": notice.label,
                "base": notice.base,
                "phrase": phrase,
                "anchor": phrase[rarest],
                "at": rarest,
                "notice": text,
                "phrase_at": _find(text, phrase),
                "weights": [idf[w] for w in text],
            }
        )
    return entries


def scan_words(words: DataFrame, idf: dict[str, float], notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """Add ``hits``: an array of ``(label, base, start, length, coverage)`` to rows with ``words``."""
    entries = _postings(notices, idf)
    anchors = sorted({e["anchor"] for e in entries})
    # Places of rare words, computed once per row; rows without any skip everything else.
    places = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
        lambda x: x["word"].isin(anchors),
    )
    some = F.arrays_overlap("words", _strings(anchors))
    rows = words.withColumn("places", F.when(some, places))

    def hits(entry: dict) -> Column:
        mine = F.filter("places", lambda x: x["word"] == entry["anchor"])
        starts = F.transform(mine, lambda x: x["at"] - entry["at"])
        size = len(entry["phrase"])
        verified = F.filter(
            starts,
            lambda s: (s >= 0) & (F.slice("words", F.greatest(s, F.lit(0)) + 1, size) == _strings(entry["phrase"])),
        )
        total = sum(entry["weights"])

        def coverage(start: Column) -> Column:
            """IDF mass of the notice words that lie at the phrase's shift."""
            mass = F.lit(0.0)
            for place, (word, weight) in enumerate(zip(entry["notice"], entry["weights"], strict=True)):
                there = F.get("words", start - entry["phrase_at"] + place)
                mass = mass + F.when(there == word, F.lit(weight)).otherwise(0.0)
            return mass / total if total > 0 else F.lit(1.0)

        return F.transform(
            verified,
            lambda s: F.struct(
                F.lit(entry["label"]).alias("label"),
                F.lit(entry["base"]).alias("base"),
                s.cast("long").alias("start"),
                F.lit(size).alias("length"),
                coverage(s).alias("coverage"),
            ),
        )

    found = F.when(F.col("places").isNotNull(), F.flatten(F.array(*[hits(e) for e in entries])))
    return rows.withColumn("hits", F.coalesce(found, F.array().cast(HITS))).drop("places")


def license_scan(
    docs: DataFrame, text: str = "text", id: str = "doc_id", notices: Sequence[Notice] = NOTICES
) -> DataFrame:
    """``(id, n_words, hits)`` for every row.

    ``hits`` lists every place of every key phrase as ``(label, base, start, length, coverage)``, with
    ``start`` in words from 0. Null and empty texts have no words and no hits. Repeated rows, null
    identifiers and other columns pass through without effect.
    """
    words = docs.select(F.col(id), words_of(text_or_empty(text)).alias("words"))
    found = scan_words(words, word_idf(words, notices), notices)
    return found.select(id, F.size("words").cast("long").alias("n_words"), "hits")


def summarize(scanned: DataFrame, id: str = "doc_id") -> DataFrame:
    """The digest columns of the scan: counts, first and last base word, labels and score."""
    base = F.filter("hits", lambda h: h["base"])

    def labels(hits: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(hits["label"])), ",")

    return scanned.withColumn("base_hits", base).select(
        F.col(id),
        "n_words",
        F.size("base_hits").cast("long").alias("n_base"),
        F.array_min(F.col("base_hits")["start"]).alias("first_word"),
        F.array_max(F.col("base_hits")["start"]).alias("last_word"),
        labels(F.col("base_hits")).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.col("hits")["coverage"]), F.lit(0.0)), 6).alias("score"),
    )
