"""Statement classification: operation type, category, and pattern type.

The rules are tables (``fixed_values``). Prefix rules become one ``CASE`` over the opening of the
statement, which is the fastest form; whole-word rules find the word once and look it up in a
constant map. Both keep the generated code of a whole parse below the size that the JVM still
compiles (8,000 bytes per method); beyond it, the parse runs two to three times slower.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions import fixed_values as fx
from auditlake.profiles import PYTHON, Profile

# Longer than any opening phrase; deciding on the opening avoids upper-casing whole statements.
OPENING_CHARS = 32


def _lookup(table: Mapping[str, str], key: str) -> str:
    """SQL that looks ``key`` up in a constant map; null if it is not there."""
    entries = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    return f"try_element_at(map({entries}), {key})"


def _opening(text: str) -> str:
    return f"upper(substring({text}, 1, {OPENING_CHARS}))"


def opening(stmt: str) -> Column:
    """The start of a statement in upper case, enough for every rule that compares prefixes."""
    return F.expr(_opening(stmt))


def _prefix_case(start: str, table: Mapping[str, str]) -> str:
    """SQL for the label of the first entry that ``start`` starts with."""
    branches = [f"WHEN startswith({start}, '{p}') THEN '{label}'" for p, label in table.items()]
    return f"CASE {' '.join(branches)} ELSE 'OTHER' END"


def op_category(stmt: str, profile: Profile = PYTHON, start: str | None = None) -> Column:
    """Category of a statement (a column name) with its leading comment already cut.

    ``start`` names a column that holds ``opening(stmt)``; many rules look at it, so it should be
    computed once, beforehand.
    """
    start = start or _opening(stmt)
    words = dict(fx.WORD_CATEGORY)
    if profile.bare_load:
        words["LOAD"] = "LOAD"
    table = {**fx.PHRASE_CATEGORY, **words}
    if profile.word_match == "whole":
        # A phrase may be followed by anything, a single word only by a non-letter.
        openings = "|".join(fx.PHRASE_CATEGORY) + "|[A-Z]+"
        found = f"regexp_extract({start}, '^({openings})', 1)"
        return F.expr(f"coalesce({_lookup(table, found)}, 'OTHER')")
    by_prefix = _prefix_case(start, table)
    if profile.loose_phrases:
        # White space inside a phrase may be any length, so this looks at the whole text, but only
        # of statements that start with the first word of a phrase.
        first_words = "|".join(dict.fromkeys(phrase.split()[0] for phrase in fx.PHRASE_CATEGORY))
        phrases = "|".join(phrase.replace(" ", r"\s+") for phrase in fx.PHRASE_CATEGORY)
        found = f"regexp_extract({stmt}, r'(?i)^({phrases})', 1)"
        label = _lookup(fx.PHRASE_CATEGORY, rf"upper(regexp_replace({found}, r'\s+', ' '))")
        candidate = f"{start} RLIKE '^({first_words})'"
        by_prefix = f"coalesce(CASE WHEN {candidate} THEN {label} END, {by_prefix})"
    return F.expr(by_prefix)


def op_type_of(category: str) -> Column:
    """Operation type of a category, which belongs to exactly one; null for null."""
    return F.expr(_lookup(fx.CATEGORY_OP_TYPE, category))


def pattern_type(pattern: str, merged: bool = False) -> Column:
    """Type under which the pattern reports list a fingerprint."""
    table = fx.PATTERN_TYPES_MERGED if merged else fx.PATTERN_TYPES_SINGLE
    return F.expr(_prefix_case(_opening(pattern), table))
