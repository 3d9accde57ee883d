"""Queries and readers leave no line out: what they return together is what went in."""

import json
import os

import pytest

from huntframe.fixtures import events_log
from huntframe.plans import queries as registered
from huntframe.sources.lines import read_json_array

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_json_array_order_keys_do_not_repeat(spark, tmp_path):
    spark.conf.set("spark.sql.files.minPartitionNum", "1")  # both files in one task
    n = (1 << 20) + 5
    for name, size in (("a.json", n), ("b.json", n - 1)):
        (tmp_path / name).write_text("[" + ",".join(["1"] * size) + "]")
    try:
        read = read_json_array(spark, str(tmp_path)).cache()
        assert read.rdd.getNumPartitions() == 1
        assert read.select("seq").distinct().count() == read.count() == 2 * n - 1
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


@needs_data
def test_json_array_files_are_bounded_and_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "array")
    monkeypatch.setattr(registered, "scratch", lambda *_: path)
    monkeypatch.setattr(registered, "EVENTS_A_FILE", 100, raising=False)
    registered.queries()["read_json_array"](spark, DATA).count()
    files = [json.loads(r.value) for r in spark.read.text(path, wholetext=True).collect() if r.value]
    total = events_log(spark, DATA).count()
    assert max(map(len, files)) <= 100 and sum(map(len, files)) == total * 9 // 10
    assert sum(e == [1, 2] for f in files for e in f) == total // 10


def seqs(spark, names):
    return sorted(r.seq for name in names for r in registered.queries()[name](spark, DATA).select("seq").collect())


@needs_data
@pytest.mark.parametrize(
    "names, lines, skipped",
    [
        (("parse_access", "parse_access_error"), "access_lines", "trim(value) = ''"),
        (("parse_syslog_3164", "parse_syslog_5424", "parse_syslog_raw"), "syslog_lines", "value LIKE '#%'"),
        (("parse_generic_json", "parse_generic_kv", "parse_generic_text", "parse_generic_text_plain"), "generic_lines", "false"),
    ],
)
def test_parse_queries_return_every_line_once(spark, monkeypatch, names, lines, skipped):
    given = getattr(registered, lines)
    mixed = lambda log: given(log).withColumn("seq", (1_000_000_007 - 3 * log["seq"]))  # noqa: E731  so that a line's form does not follow from its seq
    monkeypatch.setattr(registered, lines, mixed)
    want = sorted(r.seq for r in mixed(events_log(spark, DATA)).filter(f"NOT ({skipped})").collect())
    assert seqs(spark, names) == want


@needs_data
def test_error_lines_are_told_by_their_form(spark, monkeypatch):
    given = registered.access_lines
    mixed = lambda log: given(log).withColumn("seq", 1_000_000_007 - 3 * log["seq"])
    monkeypatch.setattr(registered, "access_lines", mixed)
    want = sorted(r.seq for r in mixed(events_log(spark, DATA)).filter("startswith(value, '[')").collect())
    assert want and seqs(spark, ["parse_access_error"]) == want
