"""SQL that states the expected result of every registered query, for any engine with regular
expressions. It is written independently of the Spark code: other regular expressions, all
normalisation rules, plain filters, window functions over whole files."""

from __future__ import annotations

IGNORE = ("SET ROLE", "SHOW TABLES", "/* rid 1 */ SELECT")
FIRST_N = 500
# More rows than a block of the view has, and more than small tables have at all.
FIRST_MANY = 10_000
DELAY_DAYS = 3
# Seconds of the first event's day, as bounds in SQL.
FIRST_DAY = """(SELECT strftime(min(ts), '%Y%m%d') || '000000' FROM events)
  AND (SELECT strftime(min(ts), '%Y%m%d') || '235959' FROM events)"""

LINES = r"""
ev AS (
  SELECT event_id AS e, user_id AS u, event_type AS y, ts,
         epoch_ms(date_trunc('day', ts)) + (event_id % 7) * 1000 + 123 AS line_ms,
         substr(CAST(date_trunc('day', ts) AS VARCHAR), 1, 10) || ' 00:00:0' AS day_text
  FROM events
),
st AS (
  SELECT *, CASE e % 23
    WHEN 0 THEN 'SELECT a||b FROM t_5 WHERE id = ' || (u % 3) || ' AND n = ''' || y || ''''
    WHEN 1 THEN '/* rid ' || e || ' */ select * from u where d = ''2024-01-02'' and x in (' || (u % 3) || ', 7)'
    WHEN 2 THEN 'with q as (select ' || (u % 2) || ') select * from q'
    WHEN 3 THEN 'SHOW TABLES'
    WHEN 4 THEN 'desc t1'
    WHEN 5 THEN 'EXPLAIN SELECT 1'
    WHEN 6 THEN 'INSERT INTO t VALUES (' || e || ', ''' || y || ''')'
    WHEN 7 THEN 'CREATE ROUTINE LOAD db.j' || (e % 3) || ' ON t'
    WHEN 8 THEN 'SUBMIT TASK AS INSERT INTO t SELECT 1'
    WHEN 9 THEN 'LOAD LABEL l' || (e % 2)
    WHEN 10 THEN 'CREATE PIPE p AS INSERT INTO t SELECT 1'
    WHEN 11 THEN 'UPDATE t SET v = ' || e || ' WHERE k = 3'
    WHEN 12 THEN 'DELETE FROM t WHERE d < 2024-01-02 03:04:05'
    WHEN 13 THEN 'TRUNCATE TABLE t'
    WHEN 14 THEN 'ALTER TABLE t DROP PARTITION (p' || (e % 4) || ')'
    WHEN 15 THEN 'CREATE TABLE t (a INT)'
    WHEN 16 THEN 'DROP TABLE t'
    WHEN 17 THEN 'SET ROLE all'
    WHEN 18 THEN 'BEGIN'
    WHEN 19 THEN 'SETTINGS x'
    WHEN 20 THEN 'LOAD DATA x'
    WHEN 21 THEN '/* only */'
    ELSE 'SELECT /* a */ 1 /* b */' END AS s
  FROM ev
),
lines AS (
  SELECT e AS event_id, CAST(e % 3 AS VARCHAR) AS file, CASE
    WHEN e % 50 = 49 THEN 'noise line'
    WHEN e % 50 = 48 THEN '{"message":"|Timestamp=' || line_ms || '|User=u|Stmt=|Time=1|"}'
    WHEN e % 50 = 47 THEN day_text || (e % 7) || '.123+08:00 | Stmt=' || s || ' | Time=' || (e % 500)
    ELSE '{"message":"|Timestamp=' || line_ms || '|User=u' || u || '|Stmt=' || s || '|Time=' || (e % 500) || '|"}'
    END AS line
  FROM st
)"""

EDGE_LINES = r"""
es AS (
  SELECT event_id AS e, epoch_ms(date_trunc('day', ts)) + (event_id % 7) * 1000 + 123 AS line_ms, CASE event_id % 9
    WHEN 0 THEN 'SELECT ' || repeat('col' || (event_id % 3) || ' = 12 and ', 500)
    WHEN 1 THEN 'SELECT x FROM t WHERE k = a1b2c3d4-ab12-cd34-ef56-abcdef123456 AND d = ''' || event_type || ''''
    WHEN 2 THEN 'insert overwrite t PARTITION(p' || (event_id % 4) || ',q) values (' || event_id || ', "' || event_type || '", "it")'
    WHEN 3 THEN 'CREATE   PIPE p' || (event_id % 2) || ' AS SELECT 1'
    WHEN 4 THEN 'LOAD    LABEL l' || (event_id % 2)
    WHEN 5 THEN '/* hint ' || (event_id % 2) || '?*/ SELECT 1'
    WHEN 6 THEN 'select  a.x from t where a.id = ' || event_id || '  and b' || (event_id % 3) || '=3 limit ' || (user_id % 3)
    WHEN 7 THEN 'DELETE FROM t'
    ELSE 'DROP TABLE t' END AS s
  FROM events),
lines AS (
  SELECT e AS event_id, CAST(e % 3 AS VARCHAR) AS file, CASE e % 9
    WHEN 7 THEN '{"message":"|User=u|Stmt=' || s || '|Time=' || (e % 500) || '|"}'
    WHEN 8 THEN '{"message":"|Timestamp=' || line_ms || '|Stmt=' || s || '|Time=' || (e % 500) || '"}'
    ELSE '{"message":"|Timestamp=' || line_ms || '|User=u|Stmt=' || s || '|Time=' || (e % 500) || '|"}' END AS line
  FROM es)"""

PLAIN_TS = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}\+\d{2}:\d{2})"


def _ignored(column: str, patterns) -> str:
    if not patterns:
        return "FALSE"
    return "(" + " OR ".join(f"starts_with(upper({column}), upper('{p}'))" for p in patterns) + ")"


def _category(profile: str) -> str:
    s = "upper(stmt)"
    if profile == "A":
        word = f"regexp_extract({s}, '^[A-Z]+')"
        return f"""CASE
      WHEN starts_with({s}, 'CREATE ROUTINE LOAD') THEN 'CREATE_ROUTINE_LOAD'
      WHEN starts_with({s}, 'LOAD LABEL') THEN 'LOAD_LABEL'
      WHEN starts_with({s}, 'CREATE PIPE') THEN 'CREATE_PIPE'
      WHEN {word} IN ('SELECT', 'WITH') THEN 'SELECT'
      WHEN {word} IN ('DESCRIBE', 'DESC') THEN 'DESCRIBE'
      WHEN {word} IN ('SHOW', 'EXPLAIN', 'INSERT', 'UPDATE', 'DELETE', 'LOAD', 'SUBMIT', 'TRUNCATE',
                      'CREATE', 'ALTER', 'DROP', 'SET', 'ROLLBACK', 'COMMIT', 'BEGIN', 'USE') THEN {word}
      ELSE 'OTHER' END"""
    if profile == "E":
        phrases = rf"""
      WHEN regexp_matches({s}, '^CREATE\s+ROUTINE\s+LOAD') THEN 'CREATE_ROUTINE_LOAD'
      WHEN regexp_matches({s}, '^LOAD\s+LABEL') THEN 'LOAD_LABEL'
      WHEN regexp_matches({s}, '^CREATE\s+PIPE') THEN 'CREATE_PIPE'"""
    else:
        phrases = f"""
      WHEN {s} LIKE 'CREATE ROUTINE LOAD%' THEN 'CREATE_ROUTINE_LOAD'
      WHEN {s} LIKE 'LOAD LABEL%' THEN 'LOAD_LABEL'
      WHEN {s} LIKE 'CREATE PIPE%' THEN 'CREATE_PIPE'"""
    return f"""CASE {phrases}
      WHEN {s} LIKE 'SELECT%' OR {s} LIKE 'WITH%' THEN 'SELECT'
      WHEN {s} LIKE 'SHOW%' THEN 'SHOW'
      WHEN {s} LIKE 'DESC%' THEN 'DESCRIBE'
      WHEN {s} LIKE 'EXPLAIN%' THEN 'EXPLAIN'
      WHEN {s} LIKE 'SUBMIT%' THEN 'SUBMIT'
      WHEN {s} LIKE 'INSERT%' THEN 'INSERT'
      WHEN {s} LIKE 'UPDATE%' THEN 'UPDATE'
      WHEN {s} LIKE 'DELETE%' THEN 'DELETE'
      WHEN {s} LIKE 'TRUNCATE%' THEN 'TRUNCATE'
      WHEN {s} LIKE 'ALTER%' THEN 'ALTER'
      WHEN {s} LIKE 'CREATE%' THEN 'CREATE'
      WHEN {s} LIKE 'DROP%' THEN 'DROP'
      WHEN {s} LIKE 'SET%' THEN 'SET'
      WHEN {s} LIKE 'ROLLBACK%' THEN 'ROLLBACK'
      WHEN {s} LIKE 'COMMIT%' THEN 'COMMIT'
      WHEN {s} LIKE 'BEGIN%' THEN 'BEGIN'
      WHEN {s} LIKE 'USE%' THEN 'USE'
      ELSE 'OTHER' END"""


OP_TYPE = """CASE
      WHEN op_category = 'SELECT' THEN 'read'
      WHEN op_category IN ('SHOW', 'DESCRIBE', 'EXPLAIN') THEN 'metadata'
      WHEN op_category IN ('CREATE_ROUTINE_LOAD', 'SUBMIT', 'LOAD_LABEL', 'CREATE_PIPE', 'INSERT',
                           'UPDATE', 'DELETE', 'TRUNCATE', 'LOAD') THEN 'write'
      WHEN op_category IN ('ALTER', 'CREATE', 'DROP') THEN 'schema_change'
      ELSE 'other' END"""

PLAIN_MS = """epoch_ms(CAST(substr(stamp, 1, 23) AS TIMESTAMP))
         - (CAST(substr(stamp, 25, 2) AS BIGINT) * 60 + CAST(substr(stamp, 28, 2) AS BIGINT)) * 60000"""
PLAIN_SECOND = "replace(replace(replace(substr(stamp, 1, 19), '-', ''), ' ', ''), ':', '')"
JSON_SECOND = "strftime(make_timestamp(CAST(stamp AS BIGINT) * 1000), '%Y%m%d%H%M%S')"


def _parsed(profile: str, ignore=()) -> str:
    if profile == "P":
        fields = rf"""
  SELECT *, starts_with(line, '{{') AS js,
    CASE WHEN starts_with(line, '{{') THEN regexp_extract(line, '\|Timestamp=(\d+)\|', 1)
         ELSE regexp_extract(line, '^{PLAIN_TS}', 1) END AS stamp,
    trim(CASE WHEN starts_with(line, '{{')
              THEN regexp_extract(line, '\|Stmt=(.*?)(?:\|[A-Za-z][A-Za-z0-9_]*=|$)', 1)
              ELSE regexp_extract(line, 'Stmt=([^|]+)', 1) END) AS raw,
    coalesce(try_cast(CASE WHEN starts_with(line, '{{') THEN regexp_extract(line, '\|Time=(\d+)\|', 1)
         ELSE regexp_extract(line, 'Time=(\d+)', 1) END AS BIGINT), 0) AS execution_time
  FROM (SELECT event_id, file, trim(line) AS line FROM lines)"""
        stmt = r"trim(regexp_replace(raw, '^/\*.*?\*/\s*', ''))"
        reason = f"""CASE WHEN stamp = '' THEN 'no_timestamp' WHEN raw = '' THEN 'no_stmt'
      WHEN {_ignored('raw', ignore)} THEN 'ignored'
      WHEN {_ignored('stmt', ignore)} THEN 'ignored_after_cut' END"""
        second = f"CASE WHEN js THEN {JSON_SECOND} ELSE {PLAIN_SECOND} END"
        ms = f"CASE WHEN js THEN CAST(stamp AS BIGINT) ELSE {PLAIN_MS} END"
    elif profile == "A":
        fields = r"""
  SELECT *, TRUE AS js,
    regexp_extract(line, '\|Timestamp=([^|]*)\|', 1) AS stamp,
    trim(regexp_extract(line, '\|Stmt=(.*?)(?:\|[A-Za-z][A-Za-z0-9_]*=|$)', 1)) AS raw,
    coalesce(try_cast(regexp_extract(line, '\|Time=([^|]*)\|', 1) AS BIGINT), 0) AS execution_time
  FROM lines"""
        stmt = r"regexp_replace(raw, '^/\*.*\*/\s*', '')"
        reason = f"""CASE
      WHEN NOT (contains(line, '|Timestamp=') AND contains(line, '|Stmt=')) THEN 'no_mark'
      WHEN stmt = '' THEN 'empty_stmt'
      WHEN {_ignored('stmt', ignore)} THEN 'ignored'
      WHEN NOT regexp_matches(line, '\\|Timestamp=[^|]*\\|') THEN 'no_timestamp' END"""
        second = "CASE WHEN length(stamp) = 13 THEN CAST(CAST(stamp AS BIGINT) // 1000 AS VARCHAR) ELSE stamp END"
        ms = "CAST(stamp AS BIGINT)"
    else:
        fields = rf"""
  SELECT *, regexp_matches(line, '^\s*\{{') AS js,
    CASE WHEN regexp_matches(line, '^\s*\{{') THEN regexp_extract(line, '\|Timestamp=([0-9]*)\|', 1)
         ELSE regexp_extract(line, '{PLAIN_TS}', 1) END AS stamp,
    CASE WHEN regexp_matches(line, '^\s*\{{') THEN trim(regexp_extract(line, '\|Stmt=([^|]*)', 1))
         ELSE regexp_extract(line, 'Stmt=([^|]*)', 1) END AS raw,
    CAST(0 AS BIGINT) AS execution_time
  FROM lines"""
        stmt = r"regexp_replace(raw, '^/\*.*\?\*/\s*', '')"
        reason = f"""CASE WHEN stamp = '' THEN 'no_timestamp' WHEN raw = '' THEN 'no_stmt'
      WHEN {_ignored('raw', ignore)} THEN 'ignored' END"""
        second = f"CASE WHEN js THEN {JSON_SECOND} ELSE {PLAIN_SECOND} END"
        ms = f"CASE WHEN js THEN CAST(stamp AS BIGINT) ELSE {PLAIN_MS} END"
    return f"""
fields AS ({fields}
),
cut AS (SELECT *, {stmt} AS stmt FROM fields),
judged AS (SELECT *, {reason} AS reason FROM cut),
rec AS (
  SELECT *, {OP_TYPE} AS op_type FROM (
    SELECT event_id, file, line, raw, stmt, execution_time,
      {ms} AS ts_ms, {second} AS second, {_category(profile)} AS op_category
    FROM judged WHERE reason IS NULL)
)"""


def _sql(profile: str, body: str, ignore=(), extra: str = "") -> str:
    return f"WITH {LINES.strip()},{_parsed(profile, ignore)}{extra}\n{body.strip()}"


# The normalisation rules of the three fingerprints.
RULES_P = [
    (r"''[^'']*''", "''STRING''"),
    (r"\b\d+\b", "NUMBER"),
    (r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", "UUID"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "TIMESTAMP"),
    (r"\d{4}-\d{2}-\d{2}", "DATE"),
]
RULES_A = [
    RULES_P[0],
    (r'"[^"]*"', '"STRING"'),
    (r"[A-Za-z_][A-Za-z0-9_]*\s*=\s*[0-9]+\s", "FIELD=NUMBER "),
    (r"[A-Za-z_][A-Za-z0-9_]*\s*=\s*[0-9]+$", "FIELD=NUMBER"),
    RULES_P[2],
    RULES_P[3],
    RULES_P[4],
    (r"PARTITION *\([^)]*\)", "PARTITION (PARTITIONS)"),
]
RULES_AGGRESSIVE = [
    RULES_P[0],
    (r'"[^"]*"', '"STRING"'),
    (r"\b[0-9]+(\.[0-9]+)?\b", "NUMBER"),
    RULES_P[4],
    (r"[0-9]{2}:[0-9]{2}:[0-9]{2}", "TIME"),
    ("DATE TIME", "TIMESTAMP"),
    RULES_P[2],
    (r"IN\s*\([^)]*\)", "IN (VALUES)"),
    (r"VALUES\s*\([^)]*\)", "VALUES (VALUES)"),
]


def _rules(column: str, rules) -> str:
    for pattern, replacement in rules:
        column = f"regexp_replace({column}, '{pattern}', '{replacement}', 'g')"
    return column


SPACED = r"trim(regexp_replace(stmt, '\s+', ' ', 'g'))"
PATTERN = {
    "P": f"substr({_rules('substr(stmt, 1, 6000)', RULES_P)}, 1, 6000)",
    "A": _rules(SPACED, RULES_A),
    "E": _rules("stmt", RULES_P),
    "aggressive": rf"trim(regexp_replace(upper({_rules(SPACED, RULES_AGGRESSIVE)}), '\s+', ' ', 'g'))",
}

TYPE_LIST = "(VALUES ('read'), ('write'), ('metadata'), ('schema_change'), ('other')) AS d(op_type)"
CELLS = """,
cells AS (SELECT op_type, op_category, second, count(*) AS n FROM rec GROUP BY ALL),
seconds AS (SELECT op_type, second, count(*) AS n FROM rec GROUP BY ALL)"""


def _average(profile: str) -> str:
    if profile == "A":
        return "floor(sum(n) * 100 / count(*)) / 100"
    return "CAST(sum(n) AS DOUBLE) / count(*)"


def _share(profile: str) -> str:
    if profile == "A":
        return "floor(n * 1000 / all_ops) / 10"
    return "n * 100 / CAST(all_ops AS DOUBLE)"


def _totals(profile: str) -> str:
    return f"""
SELECT op_type, n, CAST({_share(profile)} AS DOUBLE) AS share
FROM (
  SELECT op_type, n, (SELECT count(*) FROM rec) AS all_ops FROM (
    SELECT d.op_type, count(rec.event_id) AS n FROM {TYPE_LIST} LEFT JOIN rec USING (op_type) GROUP BY ALL
    UNION ALL SELECT 'total', count(*) FROM rec))"""


def _overall(profile: str) -> str:
    return f"""
SELECT d.op_type, coalesce(max_concurrency, 0) AS max_concurrency,
  coalesce(avg_concurrency, 0) AS avg_concurrency, coalesce(total_seconds, 0) AS total_seconds
FROM {TYPE_LIST} LEFT JOIN (
  SELECT op_type, max(n) AS max_concurrency, CAST({_average(profile)} AS DOUBLE) AS avg_concurrency,
    count(*) AS total_seconds
  FROM seconds GROUP BY op_type) USING (op_type)"""


def _by_category(profile: str) -> str:
    return f"""
SELECT op_type, op_category, max(n) AS max_concurrency, min(n) AS min_concurrency,
  CAST({_average(profile)} AS DOUBLE) AS avg_concurrency, CAST(sum(n) AS BIGINT) AS total_operations,
  count(*) AS active_seconds
FROM cells GROUP BY ALL"""


def _pattern_type(merged: bool) -> str:
    p = "upper(pattern)"
    short = "" if merged else f"""
      WHEN {p} LIKE 'SUBMIT%' THEN 'SUBMIT'
      WHEN {p} LIKE 'CREATE ROUTINE LOAD%' THEN 'CREATE_ROUTINE_LOAD'
      WHEN {p} LIKE 'LOAD LABEL%' THEN 'LOAD_LABEL'
      WHEN {p} LIKE 'CREATE PIPE%' THEN 'CREATE_PIPE'"""
    return f"""CASE
      WHEN {p} LIKE 'INSERT%' THEN 'INSERT'
      WHEN {p} LIKE 'UPDATE%' THEN 'UPDATE'
      WHEN {p} LIKE 'DELETE%' THEN 'DELETE'{short}
      WHEN {p} LIKE 'SELECT%' OR {p} LIKE 'WITH%' THEN 'SELECT'
      WHEN {p} LIKE 'SHOW%' THEN 'SHOW'
      WHEN {p} LIKE 'ALTER%' THEN 'ALTER'
      WHEN {p} LIKE 'CREATE%' THEN 'CREATE'
      WHEN {p} LIKE 'DROP%' THEN 'DROP'
      ELSE 'OTHER' END"""


def _pats(profile: str = "P", keys: str = "", source: str = "rec") -> str:
    return f""",
pats AS (SELECT {keys}{PATTERN[profile]} AS pattern, count(*) AS n, min(event_id) AS first_pos,
  min((event_id % 3) * 1000000000000 + event_id) AS first_in_files FROM {source} GROUP BY ALL)"""


def _top(merged: bool = False, tie: str = "first_pos") -> str:
    return f"""
SELECT pattern_type, rank, pattern, n FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY pattern_type ORDER BY n DESC, {tie}) AS INTEGER) AS rank
  FROM (SELECT *, {_pattern_type(merged)} AS pattern_type FROM pats WHERE n >= 2))
WHERE rank <= 10"""


TOP_A = """
SELECT op_type, rank, pattern, n FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY op_type ORDER BY n DESC, pattern DESC) AS INTEGER) AS rank
  FROM pats)
WHERE (op_type IN ('read', 'schema_change') AND rank <= 10) OR (op_type = 'write' AND rank <= 100)"""

FILE_TOTALS = """
SELECT file, count(*) AS total_ops,
  count(*) FILTER (op_type = 'read') AS read_ops, count(*) FILTER (op_type = 'write') AS write_ops,
  count(*) FILTER (op_type = 'metadata') AS metadata_ops,
  count(*) FILTER (op_type = 'schema_change') AS schema_change_ops,
  count(*) FILTER (op_type = 'other') AS other_ops
FROM rec GROUP BY file"""

LATE_LEDGER = f"""
SELECT op_type, op_category, second,
  count(*) FILTER (NOT late AND ends <= mark_all) AS n_closed,
  count(*) FILTER (NOT late AND ends > mark_all) AS n_open,
  count(*) FILTER (late) AS n_late
FROM (
  SELECT *, (event_id % 2 = 1 AND ends <= mark_even) AS late FROM (
    SELECT *, (ts_ms // 1000 + 1) * 1000 AS ends,
      max(ts_ms) FILTER (event_id % 2 = 0) OVER () - {DELAY_DAYS} * 86400000 AS mark_even,
      max(ts_ms) OVER () - {DELAY_DAYS} * 86400000 AS mark_all
    FROM rec))
GROUP BY ALL"""

METRICS = """
SELECT count(*) AS lines,
  count(*) FILTER (reason IS NULL OR reason = 'ignored_after_cut') AS parsed,
  count(*) FILTER (reason IS NULL) AS operations,
  count(*) FILTER (reason IN ('ignored', 'ignored_after_cut')) AS ignored,
  count(*) FILTER (reason NOT IN ('ignored', 'ignored_after_cut')) AS rejected
FROM judged"""
UNPARSED = {
    "P": "reason NOT IN ('ignored', 'ignored_after_cut')",
    "A": "reason = 'empty_stmt'",
    "E": "reason IS NOT NULL",
}

OPS = "SELECT op_type, op_category, second, n FROM cells"
CATEGORIES = "SELECT op_type, op_category, count(*) AS n FROM rec GROUP BY ALL"
DISTRIBUTION = "SELECT op_type, count(*) AS n FROM rec GROUP BY ALL"
RECORD = "SELECT event_id, ts_ms, second, stmt, execution_time FROM rec"
REJECTS_E = "SELECT event_id, line FROM judged WHERE reason IS NOT NULL"
REJECTS_A = "SELECT event_id, line FROM judged WHERE reason = 'empty_stmt'"


def _metrics(profile: str) -> str:
    """The line counts with the profile's count of rejected lines."""
    more = f",\n  count(*) FILTER ({UNPARSED[profile]}) AS unparsed\nFROM judged"
    return _sql(profile, METRICS.replace("\nFROM judged", more), IGNORE)


def _edge(profile: str, body: str) -> str:
    """SQL over the view of edge cases, with the same rules."""
    return _sql(profile, body, IGNORE).replace(LINES.strip(), EDGE_LINES.strip())


def _long(section: str, table: str, item: str, measures: list[str], where: str = "TRUE") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{section}' AS section, {item} AS item, '{m}' AS metric, CAST({m} AS DOUBLE) AS value "
        f"FROM ({table}) WHERE {where}"
        for m in measures
    )


def _report(profile: str, parts: list[str], ignore=(), extra: str = "") -> str:
    return _sql(profile, "\nUNION ALL\n".join(parts), ignore, CELLS + extra)


BY_CATEGORY_MEASURES = [
    "max_concurrency", "min_concurrency", "avg_concurrency", "total_operations", "active_seconds",
]
OVERALL_MEASURES = ["max_concurrency", "avg_concurrency", "total_seconds"]
TYPE_CAT = "op_type || '/' || op_category"


def _top_long(top: str, group: str) -> str:
    return (
        f"SELECT 'top_patterns' AS section, {group} || '/' || pattern AS item, "
        f"'rank ' || rank AS metric, CAST(n AS DOUBLE) AS value FROM ({top})"
    )


def oracle_sql() -> dict[str, str]:
    rw = "op_type IN ('read', 'write')"
    rws = "op_type IN ('read', 'write', 'schema_change')"
    def firsts(limit: int, where: str = "TRUE") -> str:
        return f""",
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) AS rn FROM rec WHERE {where})
  WHERE rn <= {limit})"""

    first_n = firsts(FIRST_N)
    ops = _sql("P", OPS, extra=CELLS)
    summary_fields = """
SELECT count(*) AS total_operations, count(*) FILTER (op_type = 'read') AS read_operations,
  count(*) FILTER (op_type = 'metadata') AS metadata_operations,
  count(*) FILTER (op_type = 'write') AS write_operations,
  count(*) FILTER (op_type = 'schema_change') AS schema_change_operations,
  count(*) FILTER (op_type = 'other') AS other_operations"""
    report_single = _report(
        "P",
        [
            _long("totals", _totals("P"), "op_type", ["n", "share"]),
            _long("category_counts", CATEGORIES, TYPE_CAT, ["n"]),
            _long("concurrency_overall", _overall("P"), "op_type", OVERALL_MEASURES),
            _long("concurrency_by_category", _by_category("P"), TYPE_CAT, BY_CATEGORY_MEASURES),
            _long("time_distribution", DISTRIBUTION, "op_type", ["n"]),
            _top_long(_top(), "pattern_type"),
        ],
        extra=_pats(),
    )
    file_measures = ["total_ops", "read_ops", "write_ops", "metadata_ops", "schema_change_ops", "other_ops"]
    return {
        "parse_json_lines": _sql("P", RECORD + " WHERE starts_with(line, '{')"),
        "parse_traditional_lines": _sql("P", RECORD + " WHERE NOT starts_with(line, '{')"),
        "parse_a_lines": _sql("A", RECORD),
        "parse_e_lines": _sql("E", RECORD),
        "ignore_filter": _sql("P", "SELECT event_id, stmt FROM rec", IGNORE),
        "ignore_filter_a": _sql("A", "SELECT event_id, stmt FROM rec", IGNORE),
        "ignore_filter_e": _sql("E", "SELECT event_id, stmt FROM rec", IGNORE),
        "classify_p": _sql("P", "SELECT event_id, op_type, op_category FROM rec"),
        "classify_a": _sql("A", "SELECT event_id, op_type, op_category FROM rec"),
        "classify_e": _sql("E", "SELECT event_id, op_type, op_category FROM rec"),
        "normalize_p": _sql("P", f"SELECT event_id, {PATTERN['P']} AS pattern FROM rec"),
        "normalize_a": _sql("A", f"SELECT event_id, {PATTERN['A']} AS pattern FROM rec"),
        "normalize_e": _sql("E", f"SELECT event_id, {PATTERN['E']} AS pattern FROM rec"),
        "normalize_aggressive": _sql("A", f"SELECT event_id, {PATTERN['aggressive']} AS pattern FROM rec"),
        "ops_per_second": ops,
        "ops_per_second_a": _sql("A", OPS, extra=CELLS),
        "totals": _sql("P", _totals("P")),
        **{
            f"edge_records_{profile.lower()}": _edge(
                profile,
                f"""SELECT event_id, op_type, op_category, length(stmt) AS stmt_chars, execution_time,
                {PATTERN[profile]} AS pattern FROM rec""",
            )
            for profile in "PAE"
        },
        "edge_metrics_p": _metrics("P").replace(LINES.strip(), EDGE_LINES.strip()),
        "op_share": _sql("P", _totals("P"), IGNORE),
        "op_share_a": _sql("A", _totals("A"), IGNORE),
        "category_counts": _sql("P", CATEGORIES),
        "category_counts_a": _sql("A", CATEGORIES + " HAVING " + rws),
        "category_counts_e": _sql("E", CATEGORIES + " HAVING " + rw),
        "time_distribution": _sql("P", DISTRIBUTION),
        "concurrency_overall": _sql("P", _overall("P"), extra=CELLS),
        "concurrency_overall_a": _sql("A", _overall("A"), extra=CELLS),
        "concurrency_by_category": _sql("P", _by_category("P"), extra=CELLS),
        "concurrency_by_category_a": _sql("A", _by_category("A"), extra=CELLS),
        "pattern_counts": _sql("P", "SELECT pattern, n, first_pos FROM pats", extra=_pats()),
        "pattern_counts_a": _sql("A", "SELECT op_type, pattern, n FROM pats", extra=_pats("A", "op_type, ")),
        "top_patterns": _sql("P", _top(), extra=_pats()),
        "top_patterns_multi": _sql("P", _top(True, "first_in_files"), extra=_pats()),
        "top_patterns_a": _sql("A", TOP_A, extra=_pats("A", "op_type, ")),
        "pattern_first_n": _sql("P", "SELECT pattern, n FROM pats", extra=first_n + _pats(source="firsts")),
        "pattern_first_n_many": _sql("P", "SELECT pattern, n FROM pats", extra=firsts(FIRST_MANY) + _pats(source="firsts")),
        "pattern_first_n_a": _sql(
            "A",
            "SELECT op_type, pattern, n FROM pats",
            extra=firsts(FIRST_N, f"{PATTERN['A']} <> ''") + _pats("A", "op_type, ", "firsts"),
        ),
        "file_totals": _sql("P", FILE_TOTALS),
        "merged_totals": _sql("P", _totals("P")),
        "rejects_a": _sql("A", REJECTS_A, IGNORE),
        "rejects_e": _sql("E", REJECTS_E, IGNORE),
        "reject_sample": _sql("A", REJECTS_A + " ORDER BY event_id LIMIT 10", IGNORE),
        "run_metrics": _metrics("P"),
        "run_metrics_a": _metrics("A"),
        "run_metrics_e": _metrics("E"),
        "observed_metrics_csv": _metrics("P"),
        "report_single": report_single,
        "report_merged": _report(
            "P",
            [
                _long("file_totals", FILE_TOTALS, "file", file_measures),
                _long("totals", _totals("P"), "op_type", ["n", "share"]),
                _long("category_counts", CATEGORIES, TYPE_CAT, ["n"], rw),
                _long("concurrency_overall", _overall("P"), "op_type", OVERALL_MEASURES, rw),
                _top_long(_top(True, "first_in_files"), "pattern_type"),
            ],
            extra=_pats(),
        ),
        "report_a": _report(
            "A",
            [
                _long("totals", _totals("A"), "op_type", ["n", "share"]),
                _long("category_counts", CATEGORIES, TYPE_CAT, ["n"], rws),
                _long("concurrency_overall", _overall("A"), "op_type", OVERALL_MEASURES, rws),
                _long("concurrency_by_category", _by_category("A"), TYPE_CAT, BY_CATEGORY_MEASURES, rws),
                _top_long(TOP_A, "op_type"),
            ],
            IGNORE,
            _pats("A", "op_type, "),
        ),
        "report_e": _report(
            "E",
            [
                _long("totals", _totals("E"), "op_type", ["n", "share"]),
                _long("category_counts", CATEGORIES, TYPE_CAT, ["n"], rw),
                _long("time_distribution", _totals("E"), "op_type", ["n"], "op_type <> 'total'"),
            ],
        ),
        "result_json": _sql("P", f"""
SELECT t.op_type, t.n AS total, o.max_concurrency, o.avg_concurrency, o.total_seconds,
  coalesce(c.categories, 0) AS categories
FROM ({_totals("P")}) t JOIN ({_overall("P")}) o USING (op_type)
LEFT JOIN (SELECT op_type, count(DISTINCT op_category) AS categories FROM rec GROUP BY ALL) c USING (op_type)""",
                            extra=CELLS),
        "result_json_merged": _sql("P", f"""
SELECT t.op_type, t.n AS total, o.max_concurrency, o.avg_concurrency, o.total_seconds,
  CAST(4 AS BIGINT) AS total_files, '2,0,1,0' AS files
FROM ({_totals("P")}) t JOIN ({_overall("P")}) o USING (op_type)""", extra=CELLS),
        "summary_json_a": _sql("A", summary_fields + " FROM rec", IGNORE),
        "summary_json_e": _sql(
            "E",
            summary_fields + ", (SELECT count(*) FROM judged WHERE reason IS NOT NULL) AS unparsed_sql_count FROM rec",
            IGNORE,
        ),
        "pattern_dictionary": _sql("P", "SELECT pattern, n FROM pats", extra=_pats()),
        "parsed_table": _sql("P", "SELECT event_id, op_type, op_category, second, execution_time FROM rec"),
        "parsed_table_range": _sql(
            "P",
            f"""SELECT event_id, op_category, second, execution_time FROM rec
            WHERE op_type = 'write' AND second BETWEEN {FIRST_DAY}""",
        ),
        "text_file_totals": _sql("P", FILE_TOTALS),
        "text_skipped_files": _sql(
            "P",
            f"SELECT *, FALSE AS skipped FROM ({FILE_TOTALS}) UNION ALL SELECT '3', 0, 0, 0, 0, 0, 0, TRUE",
        ),
        "text_ops_per_second": ops,
        "text_top_patterns": _sql("P", _top(True, "first_in_files"), extra=_pats()),
        "text_first_n": _sql("P", "SELECT pattern, n FROM pats", extra=first_n + _pats(source="firsts")),
        "text_rejects_e": _sql("E", "SELECT line FROM judged WHERE reason IS NOT NULL", IGNORE),
        "stream_ops_per_second": ops,
        "stream_windowed_ops": ops,
        "stream_text_ops": ops,
        "stream_late_ledger": _sql("P", LATE_LEDGER),
    }
