"""A whole run from lines, and the parts that only a run uses."""

import os
import random
import re

import numpy as np
import pytest

from huntframe.operators.forest import exact_quantile
from huntframe.operators.signatures import NEEDS, SIGNATURES, Signature, pattern_hits
from huntframe.plans.analyse import analyse
from huntframe.sources.scratch import collected, discard, kept, shared_folder
from huntframe.sources.sinks import list_runs, write_findings, write_run


def access(i, ip, path="/", status=200, size=100, agent="Mozilla"):
    return f'{ip} - - [06/Jan/2024:{10 + i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d} +0000] "GET {path} HTTP/1.1" {status} {size} "-" "{agent}"'


def test_a_run_finds_what_is_planted(spark, tmp_path):
    texts = [access(i, f"10.0.0.{i % 40}", f"/p{i % 5}") for i in range(800)]
    texts += [access(900, "6.6.6.6", f"/x?id=1'%20union%20select%20{i}", 500, agent="sqlmap/1.0") for i in range(150)]  # one minute
    texts += [access(2000, "10.0.0.1", "/big", size=10**9), "broken", "", "   "]
    lines = spark.createDataFrame(list(enumerate(texts)), "seq long, value string").repartition(3)
    run = analyse(lines, "apache")
    stats = run.stats.first()
    assert (stats.total_lines, stats.parsed_lines, stats.parse_errors) == (len(texts), len(texts) - 2, 1)
    assert run.detectors == ("Pattern", "Statistical", "ML", "Temporal")
    found = {(r.finding_type, r.source_ip): r for r in run.findings.collect()}
    wanted = {"sql_injection", "scanner_useragent", "request_rate_spike", "path_enumeration", "request_burst", "ml_behavioural_anomaly"}
    assert wanted <= {kind for kind, ip in found if ip == "6.6.6.6"} and ("large_response_bytes", "10.0.0.1") in found
    sql = found["sql_injection", "6.6.6.6"]
    assert (sql["count"], sql.severity_score, sql.severity, len(sql.evidence)) == (150, 100, "CRITICAL", 5)
    assert sql.evidence == texts[800:805] and "Corroborated by 4 detectors" in sql.description
    assert found["request_burst", "6.6.6.6"].evidence == texts[800:805]
    assert found["error_rate_spike", None].description.startswith("100% error rate") or found["error_rate_spike", None]["count"] >= 150
    scores = [r.severity_score for r in run.findings.collect()]
    assert scores == sorted(scores, reverse=True)
    assert sum(r.findings for r in run.summary.collect()) == len(scores)
    assert "6.6.6.6" in {r.source_ip for r in run.top_sources.collect()} and run.risk.first().risk > 0
    write_run(run.stats, run.merged, str(tmp_path / "runs"), "one", run.detectors, "2024-01-06", run.seconds)
    record = list_runs(spark, str(tmp_path / "runs")).first()
    assert (record.run_id, record.log_format, record.findings, record.detectors) == ("one", "apache", len(scores), list(run.detectors))
    assert record.analysis_duration_seconds == run.seconds > 0
    run.close()


def in_shared_folder(spark):
    return sorted(os.listdir(shared_folder(spark).removeprefix("file:")))


def test_a_closed_run_leaves_nothing_behind(spark):
    before = in_shared_folder(spark)
    lines = [f'10.0.0.{i % 9} - u{i % 3} [06/Jan/2024:02:{i % 60:02d}:00 +0000] "GET /{i % 40}?q=1%27+union+select HTTP/1.1" {404 if i % 5 else 200} {i}' for i in range(400)]
    run = analyse(spark.createDataFrame(list(enumerate(lines)), "seq long, value string"), "apache")
    assert run.findings.count() and len(in_shared_folder(spark)) == len(before) + 3
    run.close()
    assert in_shared_folder(spark) == before


def test_tables_are_collected_by_whoever_asks(spark):
    before = in_shared_folder(spark)
    with collected() as outer:
        with collected() as inner:
            kept(spark.range(3))
        kept(spark.range(4))
    kept_outside = kept(spark.range(5))
    assert len(inner) == 1 and len(outer) == 2 and kept_outside not in outer
    discard(kept_outside, *outer)
    assert in_shared_folder(spark) == before


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_a_run_written_twice_is_there_once(spark, tmp_path, kind):
    path = str(tmp_path / "found")
    found = spark.createDataFrame([("a", 1), ("b", 2)], "finding_type string, count long")
    read = lambda: sorted((r.finding_type, r.run_id) for r in spark.read.format(kind).load(path).selectExpr("finding_type", "cast(run_id AS string) AS run_id").collect())
    write_findings(found, path, "one", "2024-01-06", kind)
    write_findings(found.limit(1), path, "r:2", "2024-01-06", kind)
    write_findings(found, path, "one", "2024-01-06", kind)
    assert len(read()) == 3 and [r for r in read() if r[1] == "one"] == [("a", "one"), ("b", "one")]
    write_findings(found.limit(0), path, "r:2", "2024-01-06", kind)
    assert read() == [("a", "one"), ("b", "one")]
    stats = spark.createDataFrame([("apache", 3, 2, 1)], "log_format string, total_lines long, parsed_lines long, parse_errors long")
    for seconds in (1.0, 2.34567):
        write_run(stats, found, str(tmp_path / "runs"), "one", (), "2024-01-06", seconds)
    assert [r.analysis_duration_seconds for r in list_runs(spark, str(tmp_path / "runs")).collect()] == [2.346]


def test_a_run_over_nothing(spark):
    for name in ("apache", "windows_event"):
        run = analyse(spark.createDataFrame([(0, " ")], "seq long, value string"), name)
        assert tuple(run.stats.first()) == (name, 1, 0, 0) and run.findings.count() == 0
        assert run.risk.first().label == "MINIMAL RISK" and run.summary.count() == 5


def test_what_a_signature_needs_is_in_every_match():
    rng = random.Random(4)
    from huntframe.fixtures import ATTACKS

    pool = [*ATTACKS, "/wp-admin/", "x'--select", "/etc/passwd", "waitfor  delay", "0xFF pg_sleep", "on click=", "onkeyX =", "(\t) {a;b;bash", "popen(", "GoBuster", "SeDebugPrivilege", "su: x success", "schtasks /create", "wevtutil cl", "scp a 10.0.0.1", "nc -l 1.2.3.4 4444", "base64 -decode >", "account x locked", "maximum y retries"]
    for _ in range(4000):
        text = "".join(rng.choice(pool) if rng.random() < 0.6 else rng.choice("';|`$&{}%./\\ ") for _ in range(rng.randint(1, 5)))
        text = "".join(c.upper() if rng.random() < 0.3 else c for c in text)
        for s in SIGNATURES:
            if re.search(s.pattern, text):
                assert any(t in text.lower() for t in NEEDS[s.name]), (s.name, text)


def test_own_signatures(spark):
    mine = (Signature("odd", ("message",), r"o'd{2}\\x", "Odd", 10, ()), Signature("sql_injection", ("message",), "abc", "Not the listed one", 20, ()))
    log = spark.createDataFrame([(1, "o'dd\\x"), (2, "abc"), (3, None)], "seq long, message string")
    assert sorted((r.seq, r.finding_type, r.base_score) for r in pattern_hits(log, mine).collect()) == [(1, "odd", 10), (2, "sql_injection", 20)]
    assert pattern_hits(log, ()).count() == 0


def test_exact_quantile(spark):
    rng = np.random.default_rng(2)
    for values, share, room in ((rng.normal(size=700).round(1), 0.05, 3), (rng.normal(size=701), 0.5, 20), (np.array([3.0]), 0.05, 3), (np.repeat([1.0, 2.0], 50), 0.5, 100_000), (rng.normal(size=9), 1.0, 3)):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        assert np.isclose(exact_quantile(df, "x", share, room=room, bins=8), np.quantile(values, share))
    assert exact_quantile(spark.createDataFrame([], "x double"), "x", 0.5) is None
