"""Invariants, order of ties, limits, several files, streams, sinks and plan shapes."""

import bz2
import gzip
import os
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from auditlake import AWK, PYTHON, SHELL
from auditlake.functions import fixed_values as fx
from auditlake.functions import normalize
from auditlake.operators import aggregate, parse, patterns, rejects
from auditlake.plans import base, reports
from auditlake.registry.oracle import IGNORE
from auditlake.sinks import results
from auditlake.sources import text
from auditlake.sources.events import read_audit_lines
from auditlake.streaming import ops as stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def json_line(stmt, second=0, took=1):
    ms = 1754366400000 + second * 1000
    return '{"message":"|Timestamp=' + f"{ms}|Stmt={stmt}|Time={took}|" + '"}'


@pytest.fixture(scope="module")
def parsed(spark, sf_dir):
    return {
        p.name: parse.parse_lines(read_audit_lines(spark, sf_dir), p, IGNORE)
        for p in (PYTHON, AWK, SHELL)
    }


# ---- Invariants --------------------------------------------------------------------------------


@pytest.mark.parametrize("profile", [PYTHON, AWK, SHELL], ids=lambda p: p.name)
def test_sums_agree(parsed, profile):
    ops = aggregate.ops_per_second(parsed[profile.name], profile)
    totals = {r.op_type: r.n for r in aggregate.totals(ops, profile).collect()}
    assert totals["total"] == sum(n for t, n in totals.items() if t != "total")
    by_type: dict[str, int] = {}
    for r in aggregate.category_counts(ops).collect():
        by_type[r.op_type] = by_type.get(r.op_type, 0) + r.n
        assert fx.CATEGORY_OP_TYPE[r.op_category] == r.op_type
    assert by_type == {t: n for t, n in totals.items() if t != "total" and n}
    for r in aggregate.concurrency_overall(ops, profile).collect():
        assert r.total_seconds <= totals[r.op_type]
    for r in aggregate.concurrency_by_category(ops, profile).collect():
        assert r.min_concurrency <= r.max_concurrency
        assert r.min_concurrency <= r.avg_concurrency + 0.01
        assert r.avg_concurrency <= r.max_concurrency
    metrics = aggregate.run_metrics(parsed[profile.name], profile).first()
    assert metrics.operations == totals["total"]
    assert metrics.lines == metrics.operations + metrics.ignored + metrics.rejected


@pytest.mark.parametrize("profile", [PYTHON, AWK, SHELL], ids=lambda p: p.name)
def test_one_pass_equals_separate_queries(parsed, profile):
    both = base.base_aggregates(parsed[profile.name], profile)
    assert rows(both.ops) == rows(aggregate.ops_per_second(parsed[profile.name], profile))
    assert rows(both.patterns) == rows(patterns.pattern_counts(parsed[profile.name], profile))
    assert rows(both.line_counts) == rows(aggregate.run_metrics(parsed[profile.name], profile))


def test_result_does_not_depend_on_partitions(spark, sf_dir):
    lines = read_audit_lines(spark, sf_dir)
    results_by_partitions = []
    for n in (1, 7):
        df = parse.parse_lines(lines.repartition(n), PYTHON, IGNORE)
        top = patterns.top_patterns(patterns.pattern_counts(df, pos="event_id"))
        results_by_partitions.append((rows(aggregate.ops_per_second(df)), rows(top)))
    assert results_by_partitions[0] == results_by_partitions[1]


def test_a_hot_pattern_and_second(spark):
    """Two thirds of the lines share one second and one pattern; counts stay whole."""
    hot = F.col("id") % 3 > 0
    second = F.when(hot, 0).otherwise(F.col("id") % 1000)
    stmt = F.when(hot, F.lit("SELECT 1")).otherwise(F.concat(F.lit("DELETE FROM t"), F.col("id") % 50))
    line = F.concat(
        F.lit('{"message":"|Timestamp='), (second * 1000 + 1754366400000).cast("string"),
        F.lit("|Stmt="), stmt, F.lit('|Time=1|"}'),
    )
    df = parse.parse_lines(spark.range(30000).select("id", line.alias("line")))
    ops = aggregate.ops_per_second(df)
    assert max(r.n for r in ops.collect()) == 20000
    counts = {r.pattern: r.n for r in patterns.pattern_counts(df).collect()}
    assert counts["SELECT NUMBER"] == 20000 and sum(counts.values()) == 30000


def test_averages_of_profile_a_are_cut(lines):
    texts = [json_line("SELECT 1", s) for s in (0, 0, 1, 2)] + [json_line("DROP TABLE t")] * 2
    ops = aggregate.ops_per_second(parse.parse_lines(lines(texts), AWK), AWK)
    read = {r.op_type: r for r in aggregate.concurrency_overall(ops, AWK).collect()}["read"]
    assert (read.max_concurrency, read.avg_concurrency, read.total_seconds) == (2, 1.33, 3)
    shares = {r.op_type: r.share for r in aggregate.totals(ops, AWK).collect()}
    assert (shares["read"], shares["schema_change"]) == (66.6, 33.3)


# ---- Fingerprints ------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789-: 'ab_١é", max_size=60))
def test_date_rules_never_fire_after_the_number_rule(stmt):
    """Why ``normalize_basic`` leaves out the timestamp and date rules."""
    after = re.sub(r"\b\d+\b", "NUMBER", re.sub(r"'[^']*'", "'STRING'", stmt))
    after = re.sub(fx.UUID, "UUID", after)
    assert not re.search(r"\d{4}-\d{2}-\d{2}", after)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aZ_09 =.,\t", max_size=30))
def test_name_number_rules_equal_their_plain_form(stmt):
    """The look-behind and the possessive repeats change the running time only."""
    plain = [(r"[A-Za-z_][A-Za-z0-9_]*\s*=\s*[0-9]+\s", "F=N "), (r"[A-Za-z_][A-Za-z0-9_]*\s*=\s*[0-9]+\Z", "F=N")]
    fast = [(fx.FIELD_EQUALS_NUMBER, "F=N "), (fx.FIELD_EQUALS_LAST_NUMBER.replace(r"\z", r"\Z"), "F=N")]
    expected = got = stmt
    for (slow_rule, new), (fast_rule, _) in zip(plain, fast, strict=True):
        expected, got = re.sub(slow_rule, new, expected), re.sub(fast_rule, new, got)
    assert got == expected


def test_fingerprint_equals_python_regular_expressions(spark):
    """Unicode digits, letters next to digits, quotes over line ends: same as Python's ``re``."""
    samples = [
        "é1 1é ٣ x٣ _1 1_ 1.5 -7 'a\nb' '12' 3'4'5", "a'b", "''", "x=0x1F 1e5",
        "ab-12-cd", "12345678-1234-1234-1234-123456789012", "a b 2024-01-02 03:04:05",
        "deadbeef-dead-beef-dead-beefdeadbeef0",
    ]
    expected = []
    for s in samples:
        for pattern, new in [(r"'[^']*'", "'STRING'"), (r"\b\d+\b", "NUMBER"), (fx.UUID, "UUID")]:
            s = re.sub(pattern, new, s)
        expected.append(s)
    df = spark.createDataFrame([(s,) for s in samples], "s string").coalesce(1)
    assert [r[0] for r in df.select(normalize.normalize_basic(F.col("s"))).collect()] == expected


# ---- Patterns ----------------------------------------------------------------------------------


def test_ties_keep_first_occurrence(lines):
    texts = [json_line(f"DELETE FROM {t}") for t in "zyxwvutsrqpo" for _ in range(2)]
    counts = patterns.pattern_counts(parse.parse_lines(lines(texts)), pos="pos")
    top = patterns.top_patterns(counts).orderBy("rank").collect()
    assert [r.pattern[-1] for r in top] == list("zyxwvutsrq")


def test_patterns_seen_once_are_not_listed(lines):
    df = parse.parse_lines(lines([json_line("DROP TABLE a"), json_line("DROP TABLE b")] * 1))
    counts = patterns.pattern_counts(df)
    assert counts.count() == 2 and patterns.top_patterns(counts).count() == 0
    a = parse.parse_lines(lines([json_line("DROP TABLE a")]), AWK)
    assert patterns.top_patterns_by_op_type(patterns.pattern_counts(a, AWK)).count() == 1


def test_write_patterns_of_profile_a_go_to_100(lines):
    texts = [json_line(f"INSERT INTO t{i} SELECT 1") for i in range(120)]
    texts += [json_line(f"SELECT a{i}") for i in range(12)] + [json_line("SHOW TABLES")]
    counts = patterns.pattern_counts(parse.parse_lines(lines(texts), AWK), AWK)
    top = patterns.top_patterns_by_op_type(counts).collect()
    sizes = {t: sum(r.op_type == t for r in top) for t in fx.OP_TYPES}
    assert sizes == {"read": 10, "write": 100, "schema_change": 0, "metadata": 0, "other": 0}


@pytest.mark.parametrize("limit", [0, None, 1, 63, 64, 65, 500, 10**6])
def test_first_records_equals_sequential_limit(parsed, limit):
    df = parsed["P"].withColumn("block", F.floor(F.col("event_id") / 64))
    got = patterns.first_records(df, limit, ["block"], "event_id")
    expected: dict[str, list[int]] = {}
    for r in parse.records(parsed["P"]).select("file", "event_id").orderBy("event_id").collect():
        seen = expected.setdefault(r.file, [])
        if not limit or len(seen) < limit:
            seen.append(r.event_id)
    found: dict[str, list[int]] = {}
    for r in got.select("file", "event_id").orderBy("event_id").collect():
        found.setdefault(r.file, []).append(r.event_id)
    assert found == expected


@pytest.mark.parametrize("limit", [1, 40, 41, 500])
def test_first_records_of_profile_a_count_only_fingerprints(lines, limit):
    """Statements whose fingerprint is empty do not use up the limit."""
    texts = [json_line(f"DROP TABLE t{n % 3}" if n % 4 else "  ;", n) for n in range(200)]
    df = parse.parse_lines(lines(texts), AWK).withColumn("block", F.floor(F.col("pos") / 64))
    counted = [
        r.pos
        for r in parse.records(df).withColumn("p", patterns.pattern_column(AWK)).orderBy("pos").collect()
        if r.p != ""
    ]
    got = patterns.first_records(df, limit, ["block"], "pos", profile=AWK)
    assert sorted(r.pos for r in got.select("pos").collect()) == counted[:limit]


def test_first_records_read_whole_blocks_without_an_exchange(parsed, capsys):
    df = parsed["P"].withColumn("block", F.floor(F.col("event_id") / 64))
    plan = plan_of(patterns.first_records(df, 100, ["block"], "event_id"), capsys)
    assert "BroadcastHashJoin" in plan and "Window" not in plan and "Sort" not in plan
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1
    assert plan.count("events.parquet") == 1


def test_first_index_has_a_row_per_block(parsed):
    df = parsed["P"].withColumn("block", F.floor(F.col("event_id") / 64))
    index = patterns.first_index(parse.records(df), 30, ["block"], "event_id").collect()
    assert len(index) == parse.records(df).select("file", "block").distinct().count()
    inside = [r for r in index if patterns.NO_ROW < r.last < patterns.WHOLE_BLOCK]
    assert len(inside) == 3 and all(r.last // 64 == r.block for r in inside)


def test_pattern_limit_in_a_report(spark, sf_dir):
    lines = read_audit_lines(spark, sf_dir).withColumn("block", F.floor(F.col("event_id") / 64))
    report = reports.merged_report(
        lines, text_files(spark, 3), pos="event_id", pattern_limit=10, block=["block"], order="event_id"
    )
    assert report["pattern_counts"].agg(F.sum("n")).first()[0] == 30
    assert report["totals"].where("op_type = 'total'").first().n > 30


def text_files(spark, n):
    return spark.createDataFrame([(str(i), i) for i in range(n)], "file string, file_index bigint")


# ---- Text files --------------------------------------------------------------------------------


def write(path, lines, end="\n"):
    path.write_text(end.join(lines) + end, encoding="utf-8", newline="")
    return str(path)


def test_several_files(spark, tmp_path):
    b = write(tmp_path / "b.log", [json_line("DROP TABLE b")] * 2 + ["noise"])
    a = write(tmp_path / "a.log", [json_line("DROP TABLE a")] * 2, end="\r\n")
    spaced = write(tmp_path / "with space.log", [json_line("DROP TABLE c")])
    empty = write(tmp_path / "empty.log", [])
    missing = str(tmp_path / "missing.log")
    paths = [b, a, spaced, empty, missing]
    files = text.file_list(spark, paths, skip_missing=True)
    lines = text.with_line_position(text.read_lines(spark, paths, skip_missing=True))
    report = reports.merged_report(lines, files)
    totals = {r.file: (r.total_ops, r.schema_change_ops) for r in report["file_totals"].collect()}
    assert totals[b] == (2, 2) and totals[a] == (2, 2) and totals[missing] == (0, 0)
    assert totals[empty] == (0, 0) and totals[spaced] == (1, 1)
    assert len(totals) == 5
    top = report["top_patterns"].orderBy("rank").collect()
    assert [r.pattern for r in top] == ["DROP TABLE b", "DROP TABLE a"]
    assert tuple(report["run_metrics"].first())[:3] == (7, 5, 5)


def test_a_file_listed_twice_counts_twice(spark, tmp_path):
    a = write(tmp_path / "a.log", [json_line("DROP TABLE a")])
    ops = aggregate.ops_per_second(parse.parse_lines(text.read_lines(spark, [a, a])))
    assert ops.agg(F.sum("n")).first()[0] == 2


def test_only_missing_files(spark, tmp_path):
    missing = str(tmp_path / "none.log")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text.read_lines(spark, missing)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text.file_list(spark, missing)
    df = parse.parse_lines(text.read_lines(spark, missing, skip_missing=True))
    assert aggregate.totals(aggregate.ops_per_second(df)).agg(F.sum("n")).first()[0] == 0
    assert text.file_list(spark, missing, skip_missing=True).count() == 1


def test_file_list_order(spark, tmp_path):
    (tmp_path / "d").mkdir()
    z = write(tmp_path / "d" / "z.log", ["x"])
    y = write(tmp_path / "d" / "y.log", ["x"])
    a = write(tmp_path / "a.log", ["x"])
    listed = text.file_list(spark, [str(tmp_path / "d"), a]).orderBy("file_index").collect()
    assert [r.file for r in listed] == [y, z, a]
    listed = text.file_list(spark, [z, str(tmp_path / "d" / "*.log")]).orderBy("file_index").collect()
    assert [r.file for r in listed] == [z, y]


def test_line_position_over_many_splits(spark, tmp_path):
    """Small splits: positions follow the lines, and the limit cuts at the right line."""
    n = 3000
    path = write(tmp_path / "big.log", [json_line(f"DROP TABLE t{chr(97 + i % 7)}", i) for i in range(n)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = text.with_line_position(text.read_lines(spark, path))
        assert lines.rdd.getNumPartitions() > 8
        df = parse.parse_lines(lines)
        ordered = [r.second_key for r in df.orderBy("pos").select("second_key").collect()]
        assert ordered == sorted(ordered) and len(ordered) == n
        first = patterns.first_records(df, 1234, ["block_start"], "rid")
        seconds = sorted(r.second_key for r in first.select("second_key").collect())
        assert seconds == ordered[:1234]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_changed_splits_fail_instead_of_giving_a_wrong_limit(spark, lines, monkeypatch):
    df = parse.parse_lines(lines([json_line("DROP TABLE t", i) for i in range(20)]))
    df = df.withColumn("block", F.floor(F.col("pos") / 5))
    real = patterns.materialize
    monkeypatch.setattr(patterns, "materialize", lambda b: real(b.where("block < 2")))
    with pytest.raises(Exception, match="file splits changed"):
        patterns.first_records(df, 7, ["block"], "pos").collect()


def test_path_forms_lose_nothing(spark, tmp_path, monkeypatch):
    """Relative paths, wildcards and odd names: file totals, totals and patterns agree."""
    monkeypatch.chdir(tmp_path)
    (tmp_path / "logs").mkdir()
    for name in ("a.log", "b.log", "c d+%.log"):
        write(tmp_path / "logs" / name, [json_line(f"DROP TABLE {name[0]}")] * 2)
    folder = tmp_path / "logs"
    forms = [
        [f"{folder}/{{a,b}}.log"], [f"{folder}/../logs/a.log"], [f"{folder}/[^b].log"], [f"{folder}/*.log"],
        [str(folder)], [f"file:{folder}/a.log", f"{folder}/a.log"],
    ]
    for paths in forms:
        lines = text.with_line_position(text.read_lines(spark, paths))
        report = reports.merged_report(lines, text.file_list(spark, paths))
        total = lines.count()
        assert total > 0
        per_file = report["file_totals"].collect()
        assert sum(r.total_ops for r in per_file) == total and all(r.total_ops > 0 for r in per_file), paths
        assert report["pattern_counts"].agg(F.sum("n")).first()[0] == total, paths
        assert all(r.file.startswith(f"{folder}/") for r in per_file)


def test_a_broken_file_fails(spark, tmp_path):
    whole = gzip.compress("\n".join(json_line("DROP TABLE t", n) for n in range(20_000)).encode())
    (tmp_path / "cut.log.gz").write_bytes(whole[: len(whole) // 2])
    df = parse.parse_lines(text.read_lines(spark, str(tmp_path / "cut.log.gz"), skip_missing=True))
    with pytest.raises(Exception):  # noqa: B017
        aggregate.totals(aggregate.ops_per_second(df)).collect()


def cut_file(path, texts):
    whole = gzip.compress("\n".join(texts).encode())
    path.write_bytes(whole[: len(whole) // 2])
    return str(path)


def test_a_broken_file_counts_nothing_and_says_why(spark, tmp_path):
    texts = [json_line(f"DROP TABLE t{n}", n) for n in range(20_000)]
    good = write(tmp_path / "a.log", texts[:7])
    packed = tmp_path / "b.log.gz"
    packed.write_bytes(gzip.compress("\n".join(texts[:5]).encode()) + gzip.compress(b"\n" + texts[5].encode()))
    cut = cut_file(tmp_path / "c.log.gz", texts)
    empty = write(tmp_path / "d e+%.log", [])
    other = tmp_path / "f.bz2"
    other.write_bytes(bz2.compress(texts[0].encode())[:-9])
    missing = str(tmp_path / "missing.log")
    paths = [cut, str(packed), good, empty, str(other), missing]
    status = text.file_status(spark, paths)
    found = {r.file: r for r in status.collect()}
    assert [found[p].file_index for p in paths] == list(range(6))
    assert {p for p in paths if found[p].reason} == {cut, str(other), missing}
    assert found[missing].reason.startswith("FileNotFoundError") and found[cut].length is None
    assert found[good].length == os.path.getsize(good) and found[empty].length == os.path.getsize(empty)

    lines = text.with_line_position(text.read_lines(spark, paths, status=status))
    report = reports.merged_report(lines, status)
    totals = {r.file: (r.total_ops, r.reason is None) for r in report["file_totals"].collect()}
    assert totals == {
        cut: (0, False), str(packed): (6, True), good: (7, True), empty: (0, True), str(other): (0, False), missing: (0, False)
    }
    assert report["totals"].where("op_type = 'total'").first().n == 13
    assert report["run_metrics"].first().operations == 13
    # Whole files are still read strictly: one that breaks after it was found whole fails the job.
    packed.write_bytes(packed.read_bytes()[:40])
    again = text.read_lines(spark, paths, status=status)
    with pytest.raises(Exception):  # noqa: B017
        again.collect()


def test_too_many_broken_files_fail(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "MAX_BROKEN", 1)
    paths = [cut_file(tmp_path / f"{n}.gz", ["x" * 500]) for n in range(2)]
    status = text.file_status(spark, paths)
    with pytest.raises(ValueError, match="more than 1 files"):
        text.read_lines(spark, paths, status=status)


def test_unlisted_files_still_count(spark, tmp_path):
    a, b = (write(tmp_path / f"{n}.log", [json_line(f"DROP TABLE {n}")] * 2) for n in "ab")
    lines = text.with_line_position(text.read_lines(spark, [a, b]))
    report = reports.merged_report(lines, text.file_list(spark, a))
    assert {r.file: r.total_ops for r in report["file_totals"].collect()} == {a: 2, b: 2}
    assert report["pattern_counts"].agg(F.sum("n")).first()[0] == 4


# ---- Rejects, metrics, sinks -------------------------------------------------------------------


def test_reject_lists(lines):
    texts = ["noise", json_line("/* only */"), json_line("SHOW TABLES"), json_line("SELECT 1"), json_line("")]
    a = rejects.rejects(parse.parse_lines(lines(texts), AWK, ["SHOW"]), AWK)
    assert [r.line for r in a.orderBy("pos").collect()] == [texts[1], texts[4]]
    e = rejects.rejects(parse.parse_lines(lines(texts), SHELL, ["SHOW"]), SHELL)
    assert [r.line for r in e.orderBy("pos").collect()] == [texts[0], texts[2], texts[4]]
    many = parse.parse_lines(lines([json_line("")] * 25), AWK)
    sample = rejects.reject_sample(rejects.rejects(many, AWK), ["pos"]).collect()
    assert [r.pos for r in sample] == list(range(10))


def test_observed_counts(lines):
    observation = Observation()
    texts = ["noise", json_line("/* c */ SET ROLE x"), json_line("SET ROLE x"), json_line("SELECT 1")]
    df = parse.parse_lines(lines(texts), PYTHON, ["SET ROLE"], observation=observation)
    aggregate.ops_per_second(df).collect()
    assert observation.get == {"lines": 4, "parsed": 2, "operations": 1, "ignored": 2, "rejected": 1}


def read_json(path):
    parts = [p for p in path.iterdir() if p.suffix == ".json" and p.stat().st_size]
    assert len(parts) == 1
    return json.loads(parts[0].read_text(encoding="utf-8"))


def test_result_json(lines, spark, tmp_path):
    texts = [json_line("SELECT 'x'", s) for s in (0, 0, 1)] + [json_line("INSERT INTO t SELECT 1"), "noise"]
    report = reports.single_report(lines(texts), pos="pos")
    results.write_result(report, str(tmp_path))
    result = read_json(tmp_path / "result")
    assert result["summary"]["total_operations"] == 4
    assert result["read_operations"] == {
        "by_type": {"SELECT": 3},
        "concurrency": {
            "overall": {"max_concurrency": 2, "avg_concurrency": 1.5, "total_seconds": 2},
            "by_type": {
                "SELECT": {
                    "max_concurrency": 2, "min_concurrency": 1, "avg_concurrency": 1.5,
                    "total_operations": 3, "active_seconds": 2,
                }
            },
        },
    }
    assert result["other_operations"]["by_type"] == {}
    assert result["other_operations"]["concurrency"]["overall"]["max_concurrency"] == 0
    counted = spark.read.json(str(tmp_path / result["sql_patterns_folder"])).collect()
    assert {r.pattern: r.n for r in counted} == {"SELECT 'STRING'": 3, "INSERT INTO t SELECT NUMBER": 1}
    assert result["processing_monitoring"]["lines"] == 5


def test_merged_result_json(spark, sf_dir, tmp_path):
    report = reports.merged_report(read_audit_lines(spark, sf_dir), text_files(spark, 4), pos="event_id")
    results.write_merged_result(report, str(tmp_path))
    result = read_json(tmp_path / "result")
    assert result["file_info"]["total_files"] == 4
    files = spark.read.json(str(tmp_path / result["file_info"]["file_stats_folder"])).collect()
    assert sorted(r.file for r in files) == list("0123")
    assert {r.file: r.total_ops for r in files}["3"] == 0
    per_file = sum(r.total_ops for r in files)
    assert per_file == result["combined_summary"]["total_operations"]
    counted = spark.read.json(str(tmp_path / result["sql_patterns_folder"])).collect()
    assert sum(r.n for r in counted) == per_file
    assert set(result["combined_read_operations"]["concurrency"]) == {"overall"}


def test_summary_json(spark, sf_dir, tmp_path):
    report = reports.shell_report(read_audit_lines(spark, sf_dir), ["SHOW"])
    results.write_summary(report, str(tmp_path / "e"), "x.log", ["SHOW"], 5, shell=True)
    result = read_json(tmp_path / "e")
    info = result["processing_info"]
    assert info["log_file"] == "x.log" and info["ignore_patterns"] == ["SHOW"]
    assert info["pattern_limit"] == 5
    assert info["unparsed_sql_count"] + result["summary"]["total_operations"] == 1000


def test_parsed_table_is_pruned_by_type(spark, parsed, tmp_path, capsys):
    results.write_parsed(parsed["P"], str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where("op_type = 'write'").select("stmt")
    df.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(op_type" in plan and "ReadSchema: struct<stmt:string>" in plan
    assert df.count() == parsed["P"].where("op_type = 'write'").count()


def test_clustered_table_reads_few_files(spark, parsed, tmp_path, capsys):
    path = str(tmp_path / "t")
    results.write_clustered(parsed["P"].repartition(13), path, files=8)
    index = spark.read.parquet(f"{path}/index").collect()
    # About as many files as asked for and one more per type, not tasks x types.
    assert len(index) <= 8 + 5
    assert sum(r.rows for r in index) == parse.records(parsed["P"]).count()
    low, high = sorted((r.low, r.high) for r in index if r.op_type == "write")[0]
    df = results.read_clustered(spark, path, "write", low, low + 3600)
    expected = parse.records(parsed["P"]).where((F.col("op_type") == "write") & F.col("second_key").between(low, low + 3600))
    assert sorted(r.event_id for r in df.collect()) == sorted(r.event_id for r in expected.collect()) != []
    meeting = [r for r in index if r.op_type == "write" and r.low <= low + 3600 and r.high >= low]
    assert df.select("_metadata.file_path").distinct().count() <= len(meeting) < sum(r.op_type == "write" for r in index)


def test_a_day_of_a_dated_folder_is_read_alone(spark, tmp_path, capsys):
    for day, n in (("2025-08-04", 2), ("2025-08-05", 3)):
        (tmp_path / f"day={day}").mkdir()
        write(tmp_path / f"day={day}" / "a.log", [json_line("SELECT 1")] * n)
    lines = text.with_line_position(text.read_lines(spark, str(tmp_path), partitions=("day",)))
    ops = aggregate.ops_per_second(parse.parse_lines(lines.where("day = '2025-08-05'")))
    assert ops.first().n == 3
    plan = plan_of(ops, capsys)
    assert re.search(r"PartitionFilters: \[[^]]*day[^]]*2025-08-05", plan)
    report = reports.single_report(lines.where("day = '2025-08-04'"), pos="pos")
    assert report["run_metrics"].first().lines == 2


def test_single_report_over_files_orders_ties_by_file(spark, tmp_path):
    b = write(tmp_path / "b.log", ["noise", "noise"] + [json_line("SELECT b FROM t")] * 2)
    a = write(tmp_path / "a.log", [json_line("SELECT a FROM t")] * 2)
    files = text.file_list(spark, [b, a])
    lines = text.with_line_position(text.read_lines(spark, [b, a]))
    top = reports.single_report(lines, pos="pos", files=files)["top_patterns"].orderBy("rank").collect()
    assert [r.pattern for r in top] == ["SELECT b FROM t", "SELECT a FROM t"]


def test_result_lists_files_in_argument_order(spark, tmp_path):
    paths = [write(tmp_path / f"{n}.log", [json_line("SELECT 1")] * 2) for n in (3, 1, 2)]
    arguments = text.argument_list(spark, [*paths, paths[0]])
    assert [r.file for r in arguments.orderBy("position").collect()] == [*paths, paths[0]]
    results.write_ordered(arguments.repartition(3), "position", str(tmp_path / "files"))
    parts = sorted(p for p in (tmp_path / "files").iterdir() if p.name.startswith("part-"))
    written = [json.loads(line)["file"] for p in parts for line in p.read_text().splitlines()]
    assert written == [*paths, paths[0]]


# ---- Streams -----------------------------------------------------------------------------------


@pytest.fixture()
def log_folder(spark, sf_dir, tmp_path):
    folder = tmp_path / "in"
    read_audit_lines(spark, sf_dir).repartition(5).select(F.col("line").alias("value")).write.text(
        str(folder)
    )
    return folder


def line_stream(spark, folder):
    reader = spark.readStream.option("maxFilesPerTrigger", 2)
    return reader.text(str(folder)).select(F.col("value").alias("line"))


def test_stream_of_several_batches_equals_batch(spark, sf_dir, log_folder, tmp_path):
    expected = rows(aggregate.ops_per_second(parse.parse_lines(read_audit_lines(spark, sf_dir))))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = stream.append_counts(line_stream(spark, log_folder), out, state)
    query.awaitTermination()
    assert rows(stream.read_counts(spark, out)) == expected
    assert stream.manifest(spark, out).count() > 1
    # A second run over the same folder finds nothing new, and new files are added once.
    stream.append_counts(line_stream(spark, log_folder), out, state).awaitTermination()
    assert rows(stream.read_counts(spark, out)) == expected
    write(log_folder / "more.txt", [json_line("SELECT 1", -10**6)])
    stream.append_counts(line_stream(spark, log_folder), out, state).awaitTermination()
    assert sum(r[3] for r in rows(stream.read_counts(spark, out))) == sum(r[3] for r in expected) + 1


def test_windowed_stream_equals_batch(spark, sf_dir, log_folder, tmp_path):
    """With a delay longer than the disorder of the lines nothing is dropped."""
    expected = rows(aggregate.ops_per_second(parse.parse_lines(read_audit_lines(spark, sf_dir))))
    counts = stream.windowed_counts(line_stream(spark, log_folder), delay="60 days")
    out = str(tmp_path / "out")
    stream.write_windowed(counts, out, str(tmp_path / "state")).awaitTermination()
    assert rows(stream.read_windowed(spark, out)) == expected
    # A query with another checkpoint reads all input again and adds to the folder.
    counts = stream.windowed_counts(line_stream(spark, log_folder), delay="60 days")
    stream.write_windowed(counts, out, str(tmp_path / "other")).awaitTermination()
    assert rows(stream.read_windowed(spark, out)) == [(*r[:3], 2 * r[3]) for r in expected]


def test_a_new_checkpoint_adds_and_a_repeated_batch_does_not(spark, log_folder, tmp_path):
    out = str(tmp_path / "out")
    for name in ("one", "two"):
        stream.append_counts(line_stream(spark, log_folder), out, str(tmp_path / name)).awaitTermination()
    twice = rows(stream.read_counts(spark, out))
    once = rows(aggregate.ops_per_second(parse.parse_lines(line_batch(spark, log_folder))))
    assert twice == [(*r[:3], 2 * r[3]) for r in once]
    # The same batch again, as after a failure behind its commit: nothing is added.
    first = stream.manifest(spark, out).orderBy("query", "batch").first()
    counts = aggregate.ops_per_second(parse.parse_lines(line_batch(spark, log_folder)))
    assert not stream.commit_batch(counts, out, first.query, first.batch)
    assert rows(stream.read_counts(spark, out)) == twice
    # An attempt that failed before its commit is not seen, and the next one of the batch is.
    counts.write.parquet(f"{out}/data/query=lost/batch=0/attempt=a")
    assert rows(stream.read_counts(spark, out)) == twice
    assert stream.commit_batch(counts, out, "lost", 0)
    assert rows(stream.read_counts(spark, out)) == [(*r[:3], 3 * r[3]) for r in once]


def test_streams_without_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    empty = line_stream(spark, tmp_path / "in")
    out = str(tmp_path / "out")
    stream.append_counts(empty, out, str(tmp_path / "a")).awaitTermination()
    stream.ledger_counts(empty, out + "2", str(tmp_path / "b"), "1 day").awaitTermination()
    stream.write_windowed(stream.windowed_counts(empty, "1 day"), out + "3", str(tmp_path / "c")).awaitTermination()
    assert rows(stream.read_counts(spark, out)) == rows(stream.read_ledger(spark, out + "2", "1 day")) == []
    assert rows(stream.read_windowed(spark, out + "3")) == []


def line_batch(spark, folder):
    return spark.read.text(str(folder)).select(F.col("value").alias("line"))


def test_late_lines_are_kept_apart_and_lose_nothing(spark, tmp_path):
    """Closed, open and late counts of each step, with a restart in between."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    steps = [
        [json_line("SELECT 1", s) for s in (0, 0, 100)] + ["noise"],
        # The watermark is at 90 s and 123 ms: second 89 is closed, second 90 is not.
        [json_line("SELECT 1", s) for s in (89, 90, 95, 0)] + [json_line("DROP TABLE t", 300)],
        [json_line("SELECT 1", s) for s in (289, 290, 400)],
    ]
    found = []
    for n, step in enumerate(steps):
        write(folder / f"{n}.txt", step)
        lines = spark.readStream.text(str(folder)).select(F.col("value").alias("line"))
        stream.ledger_counts(lines, out, state, "10 seconds").awaitTermination()
        ledger = stream.read_ledger(spark, out, "10 seconds")
        found.append(tuple(ledger.agg(*[F.sum(c) for c in ("n_closed", "n_open", "n_late")]).first()))
    assert found == [(2, 1, 0), (5, 1, 2), (7, 1, 3)]
    assert sum(found[-1]) == stream_lines(steps)


def stream_lines(steps):
    return sum(line != "noise" for step in steps for line in step)


# ---- Plan shapes -------------------------------------------------------------------------------


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_ops_plan_shuffles_once_and_parses_once(spark, sf_dir, capsys):
    plan = plan_of(aggregate.ops_per_second(parse.parse_lines(read_audit_lines(spark, sf_dir))), capsys)
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    assert "partial_count" in plan
    assert plan.count(r"\|Stmt=([^|]*+") == 1  # the statement expression appears once
    assert r"\|Time=" not in plan  # the unused execution time is pruned
    for bad in ("Python", "Cartesian", "NestedLoop", "SortAggregate"):
        assert bad not in plan


def test_filters_do_not_repeat_the_parse(spark, sf_dir, capsys):
    df = parse.parse_lines(read_audit_lines(spark, sf_dir)).where("op_type = 'read'").select("stmt")
    assert plan_of(df, capsys).count(r"\|Stmt=([^|]*+") == 1


def test_top_patterns_limit_before_the_shuffle(spark, sf_dir, capsys):
    df = parse.parse_lines(read_audit_lines(spark, sf_dir))
    plan = plan_of(patterns.top_patterns(patterns.pattern_counts(df, pos="event_id")), capsys)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "SortAggregate" not in plan
    plan = plan_of(
        patterns.top_patterns_by_op_type(
            patterns.pattern_counts(parse.parse_lines(read_audit_lines(spark, sf_dir), AWK), AWK)
        ),
        capsys,
    )
    assert "WindowGroupLimit" in plan


def test_text_position_aggregates_by_hash(spark, tmp_path, capsys):
    path = write(tmp_path / "a.log", [json_line("SELECT 1")])
    lines = text.with_line_position(text.read_lines(spark, path))
    counts = patterns.pattern_counts(parse.parse_lines(lines), by=("file",), pos="pos")
    plan = plan_of(counts, capsys)
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_merged_report_groups_by_file_only_for_file_totals(spark, lines):
    """Many files, the same seconds and patterns: the stored table does not grow with files x patterns."""
    texts = [json_line(f"DROP TABLE t WHERE a = {n}", n % 10) for n in range(100)]
    rows_of = []
    for hosts in (1, 20):
        files = spark.createDataFrame([(f"h{n}", n) for n in range(hosts)], "file string, file_index bigint")
        df = lines(texts).crossJoin(files.select(F.col("file").alias("host"))).drop("file").withColumnRenamed("host", "file")
        found = base.merged_aggregates(parse.parse_lines(df), files, "pos")
        rows_of.append((found.ops.count(), found.patterns.count(), found.per_file.count()))
        assert found.line_counts.first().lines == 100 * hosts
    assert rows_of == [(10, 1, 1), (10, 1, 20)]


def test_merged_report_with_a_list_of_files_too_large_to_send(spark, sf_dir, monkeypatch):
    lines_of = read_audit_lines(spark, sf_dir)
    small = reports.merged_report(lines_of, text_files(spark, 2), pos="event_id")
    monkeypatch.setattr(patterns, "BROADCAST_BYTES", 0)
    large = reports.merged_report(lines_of, text_files(spark, 2), pos="event_id")
    for name in small:
        assert rows(small[name]) == rows(large[name]), name


def test_metrics_come_from_the_stored_table(spark, sf_dir, tmp_path):
    """The CSV has the counts of the stored base table, which every line enters once."""
    df = parse.parse_lines(read_audit_lines(spark, sf_dir).repartition(3), PYTHON, IGNORE)
    expected = aggregate.run_metrics(df).first().asDict()
    counts = base.base_aggregates(df).line_counts
    results.write_run_metrics(counts, str(tmp_path / "m"), "done", 1.5)
    row = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "m")).first().asDict()
    assert {k: row[k] for k in expected} == expected and (row["stage"], row["elapsed"]) == ("done", 1.5)


def test_report_reads_the_logs_once(spark, sf_dir, capsys):
    report = reports.single_report(read_audit_lines(spark, sf_dir), pos="event_id")
    for name, df in report.items():
        plan = plan_of(df, capsys)
        assert "events.parquet" not in plan and "FileScan" in plan, name
