"""Ignore list: drop statements that start with one of the given texts, in any letter case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.profiles import Profile


def effective_patterns(patterns: Sequence[str], profile: Profile) -> list[str]:
    """The texts a profile really compares with.

    A right-trims every entry, treats a pipe as a separator and skips empty entries; E skips empty
    entries; in P an empty entry is a prefix of everything.
    """
    if profile.name == "A":
        parts = [part for p in patterns for part in p.rstrip(" \t\n\x0b\x0c\r").split("|")]
        return [p for p in parts if p]
    if profile.name == "E":
        return [p for p in patterns if p]
    return list(patterns)


def is_ignored(stmt: Column, patterns: Sequence[str], profile: Profile) -> Column:
    """True where ``stmt`` starts with any pattern; equality is a special case of that."""
    texts = effective_patterns(patterns, profile)
    if not texts:
        return F.lit(False)
    # Upper-casing never makes text shorter, so this many characters decide every comparison; it
    # saves upper-casing statements that may be megabytes long.
    opening = F.upper(F.substring(stmt, 1, max(len(t.upper()) for t in texts)))
    hit = F.lit(False)
    for text in dict.fromkeys(t.upper() for t in texts):
        hit = hit | opening.startswith(text)
    return hit
