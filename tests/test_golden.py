"""Single lines and statements with their expected parse, class and fingerprint."""

import pytest
from pyspark.sql import functions as F

from auditlake import AWK, PYTHON, SHELL
from auditlake.functions import classify, normalize
from auditlake.functions import fixed_values as fx
from auditlake.operators import aggregate, parse
from auditlake.sources import events

MS = "1754366404909"
PROFILES = {"P": PYTHON, "A": AWK, "E": SHELL}


def json_line(stmt, ms=MS, tail="|Time=15|"):
    return '{"message":"|Timestamp=' + ms + "|Client=c|Stmt=" + stmt + tail + '"}'


def plain_line(stmt, stamp="2024-01-15 10:30:45.123+08:00"):
    return f"{stamp} | Stmt={stmt} | Time=15"


def parsed_all(lines, texts, profile="P", ignore=(), tz="UTC"):
    p = PROFILES[profile]
    df = parse.parse_lines(lines(texts), p, ignore, tz)
    return df.withColumn("second", parse.second_text(p)).orderBy("pos").collect()


def parsed(lines, text, profile="P", ignore=(), tz="UTC"):
    return parsed_all(lines, [text], profile, ignore, tz)[0]


RECORD_CASES = [
    # text, profile, statement, execution time, second
    (json_line("SELECT a||b FROM t"), "P", "SELECT a||b FROM t", 15, "20250805040004"),
    (json_line("SELECT a||b FROM t"), "A", "SELECT a||b FROM t", 15, "1754366404"),
    (json_line("SELECT a||b FROM t"), "E", "SELECT a", 0, "20250805040004"),
    (json_line("SELECT 1", tail=""), "P", 'SELECT 1"}', 0, "20250805040004"),
    (plain_line("SELECT 1"), "P", "SELECT 1", 15, "20240115103045"),
    (plain_line("SELECT a||b"), "P", "SELECT a", 15, "20240115103045"),
    (plain_line("SELECT 1", "2024-01-15 10:30:45.123+23:59"), "P", "SELECT 1", 15, "20240115103045"),
    (json_line("/* only */"), "P", "", 15, "20250805040004"),
    (json_line("/* a */ SELECT /* b */ 1"), "P", "SELECT /* b */ 1", 15, "20250805040004"),
    (json_line("/* a */ SELECT /* b */ 1"), "A", "1", 15, "1754366404"),
    (json_line("/* a */ SELECT /* b */ 1"), "E", "/* a */ SELECT /* b */ 1", 0, "20250805040004"),
    (json_line("/* a ?*/ SELECT 1"), "E", "SELECT 1", 0, "20250805040004"),
    (json_line("/*/ SELECT 1"), "P", "/*/ SELECT 1", 15, "20250805040004"),
    (json_line("SELECT 1", tail="|Time=15"), "P", "SELECT 1", 0, "20250805040004"),
    (json_line("/* a\u2028b */ SELECT 1"), "P", "SELECT 1", 15, "20250805040004"),
    ("\u3000\x1f " + json_line("\xa0SELECT 1\u2003") + "\t", "P", "SELECT 1", 15, "20250805040004"),
    (json_line("SELECT 'a|b=c' FROM t"), "P", "SELECT 'a", 15, "20250805040004"),
    (json_line("SELECT 1", ms="1754366404"), "A", "SELECT 1", 15, "1754366404"),
    (plain_line(" SELECT 1"), "E", " SELECT 1 ", 0, "20240115103045"),
    ("x 2024-01-15 10:30:45.123+08:00 | Stmt=SELECT 1", "E", "SELECT 1", 0, "20240115103045"),
]


@pytest.mark.parametrize("profile", PROFILES)
def test_records(lines, profile):
    cases = [(text, rest) for text, p, *rest in RECORD_CASES if p == profile]
    rows = parsed_all(lines, [text for text, _ in cases], profile)
    for row, (text, expected) in zip(rows, cases, strict=True):
        assert [row.reject_reason, row.stmt, row.execution_time, row.second] == [
            None, *expected,
        ], text


REJECT_CASES = [
    ('{"message":"|Client=c|Stmt=SELECT 1|Time=1|"}', "PAE"),
    (plain_line("SELECT 1"), "A"),
    (plain_line("SELECT 1", "2024-01-15 10:30:45.123-05:00"), "PAE"),
    (plain_line("SELECT 1", "2024-13-15 10:30:45.123+08:00"), "PA"),
    (plain_line("SELECT 1", "2024-02-30 10:30:45.123+08:00"), "PA"),
    (plain_line("SELECT 1", "2024-01-15 24:30:45.123+08:00"), "PA"),
    (plain_line("SELECT 1", "2024-01-15 10:30:60.123+08:00"), "PA"),
    (plain_line("SELECT 1", "2024-01-15 10:30:45.123+24:00"), "PA"),
    (plain_line("SELECT 1", "0000-01-15 10:30:45.123+08:00"), "PA"),
    (json_line("/* only */"), "A"),
    (json_line(""), "PAE"),
    (json_line("SELECT 1", ms="99999999999999999999"), "P"),
    (json_line("SELECT 1", ms="253402300800000"), "P"),
    ('{"message":"|Stmt=SELECT 1|Timestamp=17543', "PA"),
    ("noise", "PAE"),
    ("", "PAE"),
]


@pytest.mark.parametrize("profile", PROFILES)
def test_rejects(lines, profile):
    texts = [text for text, profiles in REJECT_CASES if profile in profiles]
    for row, text in zip(parsed_all(lines, texts, profile), texts, strict=True):
        assert row.reject_reason is not None and row.op_category is None, text


def test_instants(lines):
    rows = parsed_all(lines, [json_line("SELECT 1"), plain_line("SELECT 1")])
    assert [str(r.ts) for r in rows] == ["2025-08-05 04:00:04.909000", "2024-01-15 02:30:45.123000"]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_seconds_do_not_depend_on_the_session_zone(spark, lines, zone):
    """03:30 on this day does not exist in New York; a plain line still keeps its wall clock."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        gap = plain_line("SELECT 1", "2024-03-10 02:30:00.000+08:00")
        assert parsed(lines, gap).second == "20240310023000"
        assert parsed(lines, json_line("SELECT 1")).second == "20250805040004"
        assert parsed(lines, json_line("SELECT 1"), tz="Asia/Shanghai").second == "20250805120004"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_seconds_fold_when_clocks_go_back(lines):
    first = parsed(lines, json_line("SELECT 1", ms="1730610000000"), tz="America/New_York")
    second = parsed(lines, json_line("SELECT 1", ms="1730613600000"), tz="America/New_York")
    assert first.second == second.second == "20241103010000"


IGNORE_CASES = [
    ("/* c */ set role x", "SET ROLE", {"P": True, "A": True, "E": False}),
    ("/* c */ select 1", "/* c */ SELECT", {"P": True, "A": False, "E": True}),
    ("select 1", "SELECT 1", {"P": True, "A": True, "E": True}),
    ("select 1", "SELECT 12", {"P": False, "A": False, "E": False}),
    ("show tables", "USE|SHOW  ", {"P": False, "A": True, "E": False}),
    ("show tables", "", {"P": True, "A": False, "E": False}),
    ("straße", "STRASSE", {"P": True}),
]


@pytest.mark.parametrize("stmt,pattern,expected", IGNORE_CASES)
def test_ignore(lines, stmt, pattern, expected):
    for profile, ignored in expected.items():
        row = parsed(lines, json_line(stmt), profile, [pattern])
        assert (row.reject_reason is not None) == ignored, profile


CLASS_CASES = [
    ("SETTINGS x", {"P": "SET", "A": "OTHER", "E": "SET"}),
    ("DESCX", {"P": "DESCRIBE", "A": "OTHER", "E": "DESCRIBE"}),
    ("USERS", {"P": "USE", "A": "OTHER", "E": "USE"}),
    ("LOAD DATA x", {"P": "OTHER", "A": "LOAD", "E": "OTHER"}),
    ("CREATE  PIPE p", {"P": "CREATE", "A": "CREATE", "E": "CREATE_PIPE"}),
    ("create \t routine" + " " * 60 + "load x", {"P": "CREATE", "A": "CREATE", "E": "CREATE_ROUTINE_LOAD"}),
    ("(SELECT 1)", {"P": "OTHER", "A": "OTHER", "E": "OTHER"}),
    ("", {"P": "OTHER", "A": "OTHER", "E": "OTHER"}),
    ("ROLLBACK", {"P": "ROLLBACK", "A": "ROLLBACK", "E": "ROLLBACK"}),
    ("COMMIT", {"P": "COMMIT", "A": "COMMIT", "E": "COMMIT"}),
    ("USE db", {"P": "USE", "A": "USE", "E": "USE"}),
    ("select1", {"P": "SELECT", "A": "SELECT", "E": "SELECT"}),
    ("load label a", {"P": "LOAD_LABEL", "A": "LOAD_LABEL", "E": "LOAD_LABEL"}),
    ("describe t", {"P": "DESCRIBE", "A": "DESCRIBE", "E": "DESCRIBE"}),
    ("with a as (select 1) select 1", {"P": "SELECT", "A": "SELECT", "E": "SELECT"}),
]


@pytest.mark.parametrize("profile", PROFILES)
def test_classify(spark, profile):
    df = spark.createDataFrame([(s, e[profile]) for s, e in CLASS_CASES], "s string, expected string")
    got = df.withColumn("got", classify.op_category("s", PROFILES[profile]))
    assert got.where("got != expected").collect() == []


NORMALIZE_CASES = [
    ("P", "d = 2024-01-02 03:04:05", "d = NUMBER-NUMBER-NUMBER NUMBER:NUMBER:NUMBER"),
    ("A", "d = 2024-01-02 03:04:05", "d = TIMESTAMP"),
    ("P", "id = a1b2c3d4-ab12-cd34-ef56-abcdef123456", "id = UUID"),
    ("P", "id = 12345678-ab12-cd34-ef56-abcdef123456", "id = NUMBER-ab12-cd34-ef56-abcdef123456"),
    ("P", "x='a''b' and y=\"q\" and z=1.5", "x='STRING''STRING' and y=\"q\" and z=NUMBER.NUMBER"),
    ("P", "SELECT  t1.a_2,  3", "SELECT  t1.a_2,  NUMBER"),
    ("E", "d = '2024-01-02' and k = 7", "d = 'STRING' and k = NUMBER"),
    ("A", "select  a.x from t where a.id = 12  and b=3 limit 10",
     "select a.x from t where a.FIELD=NUMBER and FIELD=NUMBER limit 10"),
    ("A", 'insert overwrite t PARTITION(p1,p2) values (1, "z", 2024-01-02 03:04:05)',
     'insert overwrite t PARTITION (PARTITIONS) values (1, "STRING", TIMESTAMP)'),
    ("aggressive", "SELECT MIN(p) FROM a JOIN (select 1) b", "SELECT MIN (VALUES) FROM A JOIN (VALUES) B"),
    ("aggressive", "insert into t VALUES (1.5, 'x')", "INSERT INTO T VALUES (VALUES)"),
]


@pytest.mark.parametrize("variant", ["P", "A", "E", "aggressive"])
def test_normalize(spark, variant):
    cases = [(stmt, expected) for v, stmt, expected in NORMALIZE_CASES if v == variant]
    df = spark.createDataFrame(cases, "s string, expected string")
    got = df.withColumn("got", normalize.normalize(F.col("s"), variant))
    assert got.where("got != expected").collect() == []


def test_number_rule_of_the_documented_intent(spark):
    df = spark.createDataFrame([("select 1 from t2 limit 10",)], "s string")
    got = df.select(normalize.normalize_awk(F.col("s"), number_rule=True)).first()[0]
    assert got == "select NUMBER from t2 limit NUMBER"


def test_long_statements_are_cut(spark):
    df = spark.createDataFrame([("SELECT " + "1, " * 5000,)], "s string")
    got = df.select(normalize.normalize(F.col("s"), "P")).first()[0]
    assert len(got) == 6000 and got.startswith("SELECT NUMBER, NUMBER")


def test_statement_with_very_many_pipes(spark, lines):
    """The possessive pattern neither overflows the stack nor cuts the statement."""
    stmt = "SELECT a" + "||b" * 200_000
    assert parsed(lines, json_line(stmt)).stmt == stmt


PATTERN_TYPE_CASES = [
    ("CREATE PIPE p", "CREATE_PIPE", "CREATE"),
    ("CREATE ROUTINE LOAD x", "CREATE_ROUTINE_LOAD", "CREATE"),
    ("LOAD LABEL l", "LOAD_LABEL", "OTHER"),
    ("submit task", "SUBMIT", "OTHER"),
    ("with q", "SELECT", "SELECT"),
    ("desc t", "OTHER", "OTHER"),
    ("drop t", "DROP", "DROP"),
]


def test_pattern_type(spark):
    df = spark.createDataFrame(PATTERN_TYPE_CASES, "p string, single string, merged string")
    got = df.select(
        "p", classify.pattern_type("p"), classify.pattern_type("p", merged=True)
    )
    assert [tuple(r) for r in got.collect()] == PATTERN_TYPE_CASES


@pytest.mark.parametrize("profile", ["P", "A", "E"])
def test_empty_log(spark, lines, profile):
    p = PROFILES[profile]
    empty = parse.parse_lines(lines([]), p)
    ops = aggregate.ops_per_second(empty, p)
    assert {tuple(r) for r in aggregate.totals(ops, p).collect()} == {
        (t, 0, 0.0) for t in ("read", "write", "metadata", "schema_change", "other", "total")
    }
    overall = aggregate.concurrency_overall(ops, p).collect()
    assert len(overall) == 5 and all(tuple(r)[1:] == (0, 0.0, 0) for r in overall)
    assert tuple(aggregate.run_metrics(empty).first()) == (0, 0, 0, 0, 0, 0)


def test_awk_pattern_is_that_of_every_rule_in_turn(spark):
    """Statements that skip the rules for hyphens and last numbers get the pattern of all rules."""
    import re

    ends = ["", "5", "b", ")", "'", '"', " ", "\t", "-", ";", "é", "x = 7", "x = 7 ", "= 7", "x=1 =5"]
    starts = ["", "a  b\n", "k = 3 ", "d = '2024-01-02'", "2024-01-02 03:04:05 ", "PARTITION (p1,q) ", "x = 'a = 5' ", 'x "- 1" ']
    uuid = "a1b2c3d4-ab12-cd34-ef56-abcdef123456"
    texts = [s + m + e for s in starts for m in ("", uuid, " y1 = 22 and ") for e in ends]
    rules = [
        (fx.QUOTED, "'STRING'"),
        (fx.DOUBLE_QUOTED, '"STRING"'),
        (fx.FIELD_EQUALS_NUMBER, "FIELD=NUMBER "),
        (fx.FIELD_EQUALS_LAST_NUMBER.replace(r"\z", r"\Z"), "FIELD=NUMBER"),
        (fx.UUID, "UUID"),
        (fx.TIMESTAMP_TEXT, "TIMESTAMP"),
        (fx.DATE_TEXT, "DATE"),
        (fx.PARTITION_LIST, "PARTITION (PARTITIONS)"),
    ]

    def expected(text):
        text = re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")
        for pattern, replacement in rules:
            text = re.sub(pattern, replacement, text, flags=re.ASCII)
        return text

    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "stmt string")
    found = {r.stmt: r.pattern for r in frame.select("stmt", normalize.normalize(F.col("stmt"), "A").alias("pattern")).collect()}
    assert found == {t: expected(t) for t in texts} | {None: None}


def test_edge_lines_are_dealt_to_tasks_by_events(spark, tmp_path):
    """One row group of events, which one task reads, becomes lines in several tasks of bounded size."""
    n = 2 * events.EVENTS_A_TASK + 9
    made = spark.range(n).selectExpr("id AS event_id", "timestamp_ntz'2024-01-02 03:04:05' AS ts", "id AS user_id", "'a' AS event_type")
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    lines = events.read_edge_lines(spark, str(tmp_path))
    sizes = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and sum(sizes) == n and max(sizes) <= events.EVENTS_A_TASK
    plain = events.edge_lines(spark.read.parquet(f"{tmp_path}/events.parquet"))
    assert lines.exceptAll(plain).count() == plain.exceptAll(lines).count() == 0
