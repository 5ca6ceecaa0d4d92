"""From text lines to parsed records, one narrow step without any shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from auditlake.functions import classify, fields
from auditlake.functions import fixed_values as fx
from auditlake.functions.ignore import is_ignored
from auditlake.profiles import PYTHON, Profile

# Reject reasons that stand for the ignore list; all others are lines that gave no record.
IGNORED = "ignored"
IGNORED_AFTER_CUT = "ignored_after_cut"

PARSED_COLUMNS = (
    "ts",
    "second_key",
    "raw_stmt",
    "stmt",
    "execution_time",
    "reject_reason",
    "op_type",
    "op_category",
)


def parse_lines(
    lines: DataFrame,
    profile: Profile = PYTHON,
    ignore: Sequence[str] = (),
    tz: str = "UTC",
    observation: Observation | str | None = None,
) -> DataFrame:
    """Add the parsed columns to every row of ``lines`` (which needs a ``line`` column).

    All rows stay: a line that is no record, or is ignored, carries a ``reject_reason`` and null
    ``op_category``, ``op_type`` and ``second_key``. ``second_key`` is the bucket of one second in a
    cheap form (see ``second_text``), ``ts`` the instant. Unused columns are pruned, with the
    expressions that feed them.

    The line counts of ``run_metric_columns`` are observed on the way, in the pass that reads the
    lines anyway; pass an ``Observation`` to get them. The observed step also keeps later filters
    above it. Otherwise a filter on an extracted field would be pushed below the extraction and run
    every regular expression again, which measured four times slower.
    """
    step = {"P": _parse_python, "A": _parse_awk, "E": _parse_shell}[profile.name]
    is_record = F.col("reject_reason").isNull()
    parsed = (
        step(lines, profile, ignore, tz)
        .withColumn("opening", classify.opening("stmt"))
        # For every row, and blanked afterwards: the rules inside another condition are slower.
        .withColumn("op_category", classify.op_category("stmt", profile, "opening"))
        .withColumns({c: F.when(is_record, F.col(c)) for c in ("op_category", "second_key")})
        .withColumn("op_type", classify.op_type_of("op_category"))
    )
    kept = [c for c in lines.columns if c not in PARSED_COLUMNS]
    name = observation or f"auditlake_{profile.name}_{uuid.uuid4().hex}"
    return parsed.select(*kept, *PARSED_COLUMNS).observe(name, *run_metric_columns())


def run_metric_columns() -> list[Column]:
    """Aggregates for line counts, usable in ``agg`` and in ``observe``."""
    ignored = f"reject_reason IN ('{IGNORED}', '{IGNORED_AFTER_CUT}')"
    counts = {
        "lines": "true",
        # Counted before the second ignore test, so it may exceed the operations.
        "parsed": f"reject_reason IS NULL OR reject_reason = '{IGNORED_AFTER_CUT}'",
        "operations": "reject_reason IS NULL",
        "ignored": f"reject_reason IS NOT NULL AND {ignored}",
        "rejected": f"reject_reason IS NOT NULL AND NOT {ignored}",
    }
    return [F.expr(f"count_if({test}) AS {name}") for name, test in counts.items()]


def unparsed_line(profile: Profile = PYTHON) -> Column:
    """Whether a line is on the profile's reject list.

    Profile A lists only lines whose statement is empty after the cut, profile E every line that is
    not counted, and P those that are neither counted nor ignored.
    """
    reason = F.col("reject_reason")
    if profile.name == "A":
        return reason.eqNullSafe("empty_stmt")
    if profile.name == "E":
        return reason.isNotNull()
    return reason.isNotNull() & ~reason.isin(IGNORED, IGNORED_AFTER_CUT)


def records(parsed: DataFrame) -> DataFrame:
    """Only the rows that are counted."""
    return parsed.where(F.col("reject_reason").isNull())


def second_text(profile: Profile = PYTHON, key: str = "second_key"):
    """Text form of the second bucket: ``yyyyMMddHHmmss``, or epoch seconds in profile A."""
    if profile.name == "A":
        return F.col(key)
    return fields.wall_second_text(F.col(key))


def _parse_python(lines: DataFrame, profile: Profile, ignore: Sequence[str], tz: str) -> DataFrame:
    line = F.col("line")
    is_json = F.col("is_json")
    stamp, raw = F.col("stamp"), F.col("raw_stmt")
    df = (
        lines.withColumn("line", fields.strip(line))
        .withColumn("is_json", line.startswith("{"))
        .withColumns(
            {
                "stamp": F.when(is_json, fields.json_timestamp(line)).otherwise(
                    fields.plain_timestamp(line)
                ),
                "raw_stmt": F.when(is_json, fields.statement_to_next_field(line)).otherwise(
                    fields.statement_to_pipe(line)
                ),
                "execution_time": fields.execution_time(
                    F.when(is_json, F.regexp_extract(line, fx.JSON_TIME, 1)).otherwise(
                        F.regexp_extract(line, fx.PLAIN_TIME, 1)
                    )
                ),
            }
        )
        # Separate steps: a text that is used several times must be computed before it is used.
        .withColumn("raw_stmt", fields.strip(raw))
        .withColumn("stmt", fields.strip_leading_comment(raw, profile.name))
        .withColumn("stmt", fields.strip(F.col("stmt")))
        .withColumn(
            "second_key",
            F.when(
                is_json, fields.epoch_ms_to_wall_second(fields.as_bigint(stamp), tz)
            ).otherwise(fields.plain_wall_second("stamp")),
        )
    )
    second = F.col("second_key")
    return df.withColumns(
        {
            "ts": F.when(
                second.isNotNull(),
                F.when(is_json, F.timestamp_millis(fields.as_bigint(stamp))).otherwise(
                    fields.plain_instant(stamp, second)
                ),
            ),
            "reject_reason": F.when(stamp == "", "no_timestamp")
            .when(raw == "", "no_stmt")
            .when(second.isNull(), "bad_timestamp")
            .when(is_ignored(raw, ignore, profile), IGNORED)
            .when(is_ignored(F.col("stmt"), ignore, profile), IGNORED_AFTER_CUT),
        }
    )


def _parse_awk(lines: DataFrame, profile: Profile, ignore: Sequence[str], tz: str) -> DataFrame:
    line, stmt, stamp = F.col("line"), F.col("stmt"), F.col("stamp")
    has_marks = line.contains(fx.TIMESTAMP_MARK) & line.contains(fx.STMT_MARK)
    after_mark = F.locate(fx.TIMESTAMP_MARK, line) + len(fx.TIMESTAMP_MARK)
    df = (
        lines.withColumns(
            {
                "has_marks": has_marks,
                "stamp_closed": F.substring(line, after_mark, F.length(line)).contains("|"),
                "raw_stmt": fields.statement_to_next_field(line),
                "stamp": F.regexp_extract(line, fx.TIMESTAMP_FIELD, 1),
                "execution_time": fields.execution_time(
                    F.regexp_extract(line, fx.TIME_FIELD, 1)
                ),
            }
        )
        .withColumn("raw_stmt", fields.strip(F.col("raw_stmt"), posix=True))
        .withColumn("stmt", fields.strip_leading_comment(F.col("raw_stmt"), profile.name))
    )
    second = fields.epoch_second_text(stamp)
    instant_seconds = fields.as_bigint(second)
    in_range = instant_seconds.between(0, fx.MAX_EPOCH_SECOND)
    return df.withColumns(
        {
            "second_key": second,
            "ts": F.when(
                in_range,
                F.when(F.length(stamp) == 13, F.timestamp_millis(fields.as_bigint(stamp))).otherwise(
                    F.timestamp_seconds(instant_seconds)
                ),
            ),
            "reject_reason": F.when(~F.col("has_marks"), "no_mark")
            .when(stmt == "", "empty_stmt")
            .when(is_ignored(stmt, ignore, profile), IGNORED)
            .when(~F.col("stamp_closed"), "no_timestamp"),
        }
    )


def _parse_shell(lines: DataFrame, profile: Profile, ignore: Sequence[str], tz: str) -> DataFrame:
    line, raw, stamp = F.col("line"), F.col("raw_stmt"), F.col("stamp")
    is_json = F.col("is_json")
    df = (
        lines.withColumn(
            "is_json", F.ltrim(line, F.lit(fx.POSIX_SPACE)).startswith("{")
        )
        .withColumns(
            {
                "stamp": F.when(
                    is_json, F.regexp_extract(line, fx.JSON_TIMESTAMP_OR_EMPTY, 1)
                ).otherwise(fields.plain_timestamp(line, at_start=False)),
                "raw_stmt": F.when(
                    is_json, F.regexp_extract(line, fx.STMT_FIELD_TO_PIPE, 1)
                ).otherwise(F.regexp_extract(line, fx.STMT_TO_PIPE_OR_EMPTY, 1)),
                "execution_time": F.lit(0).cast("bigint"),
            }
        )
        # Plain lines keep the white space around the statement.
        .withColumn("raw_stmt", F.when(is_json, fields.strip(raw, posix=True)).otherwise(raw))
        .withColumns(
            {
                "stmt": fields.strip_leading_comment(raw, profile.name),
                "second_key": F.when(
                    is_json, fields.epoch_ms_to_wall_second(fields.as_bigint(stamp), tz)
                ).otherwise(fields.plain_wall_second("stamp")),
            }
        )
    )
    second = F.col("second_key")
    return df.withColumns(
        {
            # A timestamp out of range does not reject the line here; it only has no second.
            "ts": F.when(
                second.isNotNull(),
                F.when(is_json, F.timestamp_millis(fields.as_bigint(stamp))).otherwise(
                    fields.plain_instant(stamp, second)
                ),
            ),
            "reject_reason": F.when(stamp == "", "no_timestamp")
            .when(raw == "", "no_stmt")
            .when(is_ignored(raw, ignore, profile), IGNORED),
        }
    )
