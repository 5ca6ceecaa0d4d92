"""Audit lines derived from an ``events`` table, one line per event.

The view turns the given table into log lines of both line formats, with all statement kinds, empty
statements and noise lines, by a fixed rule of ``event_id``; so every report can run on the given
tables and be compared with SQL over the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Statement by ``event_id % 23``; names in braces stand for numbers and words of the event.
STATEMENTS = (
    "SELECT a||b FROM t_5 WHERE id = {user%3} AND n = '{type}'",
    "/* rid {id} */ select * from u where d = '2024-01-02' and x in ({user%3}, 7)",
    "with q as (select {user%2}) select * from q",
    "SHOW TABLES",
    "desc t1",
    "EXPLAIN SELECT 1",
    "INSERT INTO t VALUES ({id}, '{type}')",
    "CREATE ROUTINE LOAD db.j{id%3} ON t",
    "SUBMIT TASK AS INSERT INTO t SELECT 1",
    "LOAD LABEL l{id%2}",
    "CREATE PIPE p AS INSERT INTO t SELECT 1",
    "UPDATE t SET v = {id} WHERE k = 3",
    "DELETE FROM t WHERE d < 2024-01-02 03:04:05",
    "TRUNCATE TABLE t",
    "ALTER TABLE t DROP PARTITION (p{id%4})",
    "CREATE TABLE t (a INT)",
    "DROP TABLE t",
    "SET ROLE all",
    "BEGIN",
    "SETTINGS x",
    "LOAD DATA x",
    "/* only */",
    "SELECT /* a */ 1 /* b */",
)
PLACEHOLDERS = {
    "{user%3}": "user_id % 3",
    "{user%2}": "user_id % 2",
    "{id%2}": "event_id % 2",
    "{id%3}": "event_id % 3",
    "{id%4}": "event_id % 4",
    "{id}": "event_id",
    "{type}": "event_type",
}


def _statement() -> str:
    texts = ", ".join('"' + text + '"' for text in STATEMENTS)
    sql = f"element_at(array({texts}), CAST(event_id % {len(STATEMENTS)} AS INT) + 1)"
    for name, value in PLACEHOLDERS.items():
        sql = f"replace({sql}, '{name}', CAST({value} AS STRING))"
    return sql


LINE = r"""
CASE slot
  WHEN 49 THEN 'noise line'
  WHEN 47 THEN concat(day, ' 00:00:0', event_id % 7, '.123+08:00 | Stmt=', stmt_text, ' | Time=', took)
  ELSE concat('{"message":"|Timestamp=', line_ms, '|User=u', user_text, '|Stmt=', stmt_text, '|Time=',
    took, '|"}')
END"""


def audit_lines(events: DataFrame) -> DataFrame:
    """``(event_id, file, line)`` from ``events(event_id, ts, user_id, event_type)``."""
    return (
        events.selectExpr("*", "CAST(ts AS DATE) AS day", "event_id % 50 AS slot")
        .selectExpr(
            "event_id",
            "slot",
            "day",
            "unix_date(day) * 86400000L + (event_id % 7) * 1000 + 123 AS line_ms",
            # One slot has an empty statement.
            "IF(slot = 48, '', CAST(user_id AS STRING)) AS user_text",
            f"IF(slot = 48, '', {_statement()}) AS stmt_text",
            "IF(slot = 48, 1, event_id % 500) AS took",
        )
        .selectExpr("event_id", "CAST(event_id % 3 AS STRING) AS file", f"{LINE} AS line")
    )


def read_audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit-line view of ``<sf_dir>/events.parquet``; only the needed columns are read."""
    return audit_lines(spark.read.parquet(f"{sf_dir}/events.parquet"))


# Statements at the edges of the rules, by ``event_id % 9``: longer than the cut, identifiers, double quotes,
# loose spaces, a question-mark comment, names with numbers, a line without timestamp, a time without end.
EDGE_STATEMENTS = (
    "SELECT {long}",
    "SELECT x FROM t WHERE k = a1b2c3d4-ab12-cd34-ef56-abcdef123456 AND d = '{type}'",
    'insert overwrite t PARTITION(p{id%4},q) values ({id}, "{type}", "it")',
    "CREATE   PIPE p{id%2} AS SELECT 1",
    "LOAD    LABEL l{id%2}",
    "/* hint {id%2}?*/ SELECT 1",
    "select  a.x from t where a.id = {id}  and b{id%3}=3 limit {user%3}",
    "DELETE FROM t",
    "DROP TABLE t",
)
LONG_TEXT = "repeat(concat('col', event_id % 3, ' = 12 and '), 500)"
# Events a task turns into edge lines. A compressed event takes some 20 bytes and its line up to 7,000, so splits
# by bytes of the events, or by their row groups, leave whole tables to a few tasks.
EVENTS_A_TASK = 25_000
EDGE_LINE = """
CASE slot
  WHEN 7 THEN concat('{"message":"|User=u|Stmt=', stmt_text, '|Time=', event_id % 500, '|"}')
  WHEN 8 THEN concat('{"message":"|Timestamp=', line_ms, '|Stmt=', stmt_text, '|Time=', event_id % 500, '"}')
  ELSE concat('{"message":"|Timestamp=', line_ms, '|User=u|Stmt=', stmt_text, '|Time=', event_id % 500, '|"}')
END"""


def edge_lines(events: DataFrame) -> DataFrame:
    """``(event_id, file, line)`` from ``events(event_id, ts, user_id, event_type)``: the edge cases."""
    slots = len(EDGE_STATEMENTS)
    quoted = ", ".join(f"'{t}'" if '"' in t else f'"{t}"' for t in EDGE_STATEMENTS)
    stmt = f"element_at(array({quoted}), CAST(event_id % {slots} AS INT) + 1)"
    for name, value in PLACEHOLDERS.items():
        stmt = f"replace({stmt}, '{name}', CAST({value} AS STRING))"
    # The long text is made only where it is put in.
    filled = f"IF(contains(stmt_text, '{{long}}'), replace(stmt_text, '{{long}}', {LONG_TEXT}), stmt_text) AS stmt_text"
    day_ms = "unix_date(CAST(ts AS DATE)) * 86400000L"
    return (
        events.selectExpr("*", f"event_id % {slots} AS slot", f"{day_ms} + (event_id % 7) * 1000 + 123 AS line_ms")
        .selectExpr("event_id", "slot", "line_ms", f"{stmt} AS stmt_text")
        .selectExpr("event_id", "slot", "line_ms", filled)
        .selectExpr("event_id", "CAST(event_id % 3 AS STRING) AS file", f"{EDGE_LINE} AS line")
    )


def read_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge cases of ``<sf_dir>/events.parquet``, dealt evenly to tasks before lines are made of them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    tasks = -(-events.count() // EVENTS_A_TASK)  # counted from the footers
    return edge_lines(events.repartition(max(1, tasks)))
