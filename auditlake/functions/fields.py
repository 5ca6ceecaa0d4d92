"""Field extraction from one log line: Column in, Column out.

Each function evaluates at most one regular expression per row, and patterns start with a literal so
that the search skips ahead quickly. Nothing here can fail a job: bad numbers and dates become null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions import fixed_values as fx

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def strip(text: Column, posix: bool = False) -> Column:
    """Remove white space at both ends (the plain SQL trim removes spaces only).

    Trimming a set of characters walks the whole text, so it is done only where the first or the
    last character can be white space at all: that is, is not a printable ASCII character. As the
    text is used several times, it should be a plain column and not an expression.
    """
    trimmed = F.trim(text, F.lit(fx.POSIX_SPACE if posix else fx.UNICODE_SPACE))
    first, last = F.ascii(text), F.ascii(F.substring(text, -1, 1))
    clean = first.between(33, 126) & last.between(33, 126)
    return F.when(clean, text).otherwise(trimmed)


def json_timestamp(line: Column) -> Column:
    """Digits of the first closed timestamp field, empty if there is none."""
    return F.regexp_extract(line, fx.JSON_TIMESTAMP, 1)


def plain_timestamp(line: Column, at_start: bool = True) -> Column:
    """Date, time and positive offset of a plain line, empty if there is none."""
    return F.regexp_extract(line, ("^" if at_start else "") + fx.PLAIN_TIMESTAMP, 1)


def statement_to_next_field(line: Column) -> Column:
    """Statement text up to the next ``|Name=``; pipes inside the statement survive."""
    return F.regexp_extract(line, fx.STMT_TO_NEXT_FIELD, 1)


def statement_to_pipe(line: Column) -> Column:
    """First non-empty statement text, cut at the first pipe."""
    return F.regexp_extract(line, fx.STMT_TO_PIPE, 1)


def as_bigint(digits: Column) -> Column:
    """Digits to BIGINT; null for empty text or a number too large."""
    return digits.try_cast("bigint")


def execution_time(digits: Column) -> Column:
    """Execution time in milliseconds, 0 where the field is missing."""
    return F.coalesce(as_bigint(digits), F.lit(0).cast("bigint"))


def strip_leading_comment(stmt: Column, profile_name: str) -> Column:
    """Cut a comment the statement starts with.

    P cuts the first comment only, A cuts up to the last comment end, and E cuts only comments that
    end in ``?*/``, because its pattern takes the question mark literally.
    """
    has_comment = stmt.startswith("/*")
    # The closing mark must start after the two opening characters.
    end = F.locate("*/", stmt, 3)
    if profile_name == "P":
        rest = F.substring(stmt, end + 2, F.length(stmt))
        return F.when(has_comment & (end > 0), rest).otherwise(stmt)
    if profile_name == "A":
        rest = F.substring_index(stmt, "*/", -1)
        cut = F.ltrim(rest, F.lit(fx.POSIX_SPACE))
        return F.when(has_comment & (end > 0), cut).otherwise(stmt)
    cut = F.regexp_replace(stmt, r"(?s)^/\*.*\?\*/\s*", "")
    return F.when(has_comment, cut).otherwise(stmt)


def epoch_ms_to_wall_second(ms: Column, tz: str) -> Column:
    """Epoch milliseconds to the wall-clock second in ``tz``, counted from 1970; null past year 9999.

    A number groups and shuffles more cheaply than a formatted timestamp, so the text form is made
    after aggregation (``wall_second_text``).
    """
    # One day of slack before the zone shift keeps the conversion inside the range of timestamps.
    bounded = F.when(ms <= (fx.MAX_EPOCH_SECOND + 86400) * 1000, ms)
    if tz == "UTC":
        wall = F.floor(bounded / 1000)
    else:
        wall = F.unix_seconds(F.from_utc_timestamp(F.timestamp_millis(bounded), tz))
    return F.when(wall <= fx.MAX_EPOCH_SECOND, wall)


def plain_wall_second(stamp: str) -> Column:
    """Wall-clock second of a plain timestamp in its own offset; null if any part is out of range.

    ``stamp`` names the column. Computed from the date and the clock digits, so the session time
    zone plays no part.
    """

    def part(start: int) -> str:
        return f"substring({stamp}, {start}, 2)"

    def number(start: int) -> str:
        return f"try_cast({part(start)} AS BIGINT)"

    # All parts are two digits, so they compare as text.
    limits = {12: "23", 15: "59", 18: "59", 25: "23", 28: "59"}
    in_range = " AND ".join(f"{part(i)} <= '{limit}'" for i, limit in limits.items())
    return F.expr(
        f"""CASE WHEN substring({stamp}, 1, 4) > '0000' AND {in_range}
            THEN unix_date(try_cast(substring({stamp}, 1, 10) AS DATE)) * 86400L
                 + {number(12)} * 3600 + {number(15)} * 60 + {number(18)} END"""
    )


def plain_instant(stamp: Column, wall_second: Column) -> Column:
    """The instant of a plain timestamp: wall clock minus offset."""
    millis = F.substring(stamp, 21, 3).try_cast("bigint")
    offset_minutes = F.substring(stamp, 25, 2).try_cast("bigint") * 60 + F.substring(
        stamp, 28, 2
    ).try_cast("bigint")
    return F.timestamp_millis(wall_second * 1000 + millis - offset_minutes * 60000)


def wall_second_text(wall_second: Column) -> Column:
    """Wall-clock second as ``yyyyMMddHHmmss``, independent of the session time zone."""
    return F.translate(
        F.timestamp_add("SECOND", wall_second, F.expr(EPOCH)).cast("string"), "- :", ""
    )


def epoch_second_text(stamp: Column) -> Column:
    """A's second bucket: 13 characters are milliseconds, anything else is used as it is."""
    leading_digits = as_bigint(F.regexp_extract(stamp, "^[0-9]+", 0))
    seconds = F.floor(F.coalesce(leading_digits, F.lit(0)) / 1000)
    return F.when(F.length(stamp) == 13, seconds.cast("string")).otherwise(stamp)
