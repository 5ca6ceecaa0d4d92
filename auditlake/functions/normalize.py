"""SQL fingerprints: replace literal values by placeholders so that similar statements look alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions import fixed_values as fx


def _replace_all(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def normalize_basic(stmt: Column) -> Column:
    """Quoted text, whole numbers, UUIDs; letter case and spacing are kept.

    The full rule list ends with timestamp and date rules. They are left out because the number rule
    always rewrites the middle of a date first, so they can never match; a test checks that.
    """
    return _replace_all(
        stmt, [(fx.QUOTED, "'STRING'"), (fx.NUMBER, "NUMBER"), (fx.UUID, "UUID")]
    )


def normalize_python(stmt: Column) -> Column:
    """P: the basic rules between two cuts at the maximum statement length."""
    pattern = normalize_basic(F.substring(stmt, 1, fx.MAX_STATEMENT_CHARS))
    return F.substring(pattern, 1, fx.MAX_STATEMENT_CHARS)


def normalize_awk(stmt: Column, number_rule: bool = False) -> Column:
    """A: also collapses spaces, and replaces ``name = number`` and partition lists.

    ``number_rule`` adds the number rule that the variant documents but that never takes effect
    there; the default reproduces the observed results.

    Four rules cannot match a statement without a hyphen that ends in a printable character other than
    a digit: no rule adds a hyphen or changes what kind of character comes last. Such statements skip
    them, since each rule reads the whole text.
    """
    last = F.ascii(F.substring(stmt, -1, 1))
    skips = last.between(33, 126) & ~last.between(48, 57) & ~stmt.contains("-")
    spaced = F.trim(F.regexp_replace(stmt, r"\s+", " "))

    def replaced(every_rule: bool) -> Column:
        rules = [
            (fx.QUOTED, "'STRING'"),
            (fx.DOUBLE_QUOTED, '"STRING"'),
            (fx.FIELD_EQUALS_NUMBER, "FIELD=NUMBER "),
        ]
        if every_rule:
            rules.append((fx.FIELD_EQUALS_LAST_NUMBER, "FIELD=NUMBER"))
        if number_rule:
            rules.append((fx.ASCII_NUMBER, "NUMBER"))
        if every_rule:
            rules += [(fx.UUID, "UUID"), (fx.TIMESTAMP_TEXT, "TIMESTAMP"), (fx.DATE_TEXT, "DATE")]
        return _replace_all(spaced, [*rules, (fx.PARTITION_LIST, "PARTITION (PARTITIONS)")])

    return F.when(skips, replaced(False)).otherwise(replaced(True))


def normalize_aggressive(stmt: Column) -> Column:
    """The strongest variant: also decimals and value lists, and everything in upper case.

    No word boundary is required before ``IN``, so ``MIN (x)`` and ``JOIN (...)`` are rewritten too.
    """
    spaced = F.trim(F.regexp_replace(stmt, r"\s+", " "))
    replaced = _replace_all(
        spaced,
        [
            (fx.QUOTED, "'STRING'"),
            (fx.DOUBLE_QUOTED, '"STRING"'),
            (fx.DECIMAL_NUMBER, "NUMBER"),
            (fx.DATE_TEXT, "DATE"),
            (fx.TIME_TEXT, "TIME"),
            ("DATE TIME", "TIMESTAMP"),
            (fx.UUID, "UUID"),
            (fx.IN_LIST, "IN (VALUES)"),
            (fx.VALUES_LIST, "VALUES (VALUES)"),
        ],
    )
    upper = F.translate(replaced, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.trim(F.regexp_replace(upper, r"\s+", " "))


def normalize(stmt: Column, variant: str = "P") -> Column:
    """Fingerprint by variant name: ``P``, ``A``, ``E`` or ``aggressive``."""
    functions = {
        "P": normalize_python,
        "A": normalize_awk,
        "E": normalize_basic,
        "aggressive": normalize_aggressive,
    }
    return functions[variant](stmt)
