"""Lines that gave no record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import fixed_values as fx
from auditlake.profiles import AWK, Profile


def rejects(parsed: DataFrame, profile: Profile = AWK) -> DataFrame:
    """Rejected rows as the profile lists them.

    A lists lines whose statement is empty once the comment is cut; lines without the field marks
    are not listed. E lists every line that gave no record, ignored statements included. P keeps no
    such list; all its rows with a reason are returned.
    """
    if profile.name == "A":
        return parsed.where(F.col("reject_reason") == "empty_stmt")
    return parsed.where(F.col("reject_reason").isNotNull())


def reject_sample(
    rejected: DataFrame, order: list[str], rows: int = fx.REJECT_SAMPLE_ROWS
) -> DataFrame:
    """The first rejected rows in file order (a top-k per task, merged on the driver side)."""
    return rejected.orderBy(*order).limit(rows)
