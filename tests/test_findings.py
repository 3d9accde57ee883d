"""Detectors and findings against plain re-tellings of their rules."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from huntframe.operators import findings as fnd
from huntframe.operators import statistical as stat
from huntframe.operators import temporal as temp
from huntframe.operators.forest import average_path, isolation_forest_scores, ml_behavioural_anomaly
from huntframe.operators.signatures import SIGNATURES, pattern_findings, pattern_hits
from huntframe.schema import FINDING, LOG_ENTRY, arrival, conform

START = datetime(2024, 1, 6, 2, 0, 0)  # a Saturday night


def log(spark, entries):
    rows = [{"seq": i, "raw": f"line {i}", **e} for i, e in enumerate(entries)]
    for r in rows:
        if "ts" in r:
            r["ts_local"] = r["ts"]
    names = LOG_ENTRY.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LOG_ENTRY)


def test_burst_matches_a_sliding_window(spark):
    rng = random.Random(3)
    entries = [{"source_ip": f"ip{rng.randint(0, 5)}", "ts": START + timedelta(seconds=rng.randint(0, 400))} for _ in range(300)]
    df = log(spark, entries)
    expected = {}
    for ip in {e["source_ip"] for e in entries}:
        own = sorted((e["ts"], i) for i, e in enumerate(entries) if e["source_ip"] == ip)
        left = 0
        for right in range(len(own)):
            while own[right][0] - own[left][0] > timedelta(seconds=20):
                left += 1
            if right - left + 1 >= 5:
                expected[ip] = own[left]
                break
    got = {r.source_ip: (r.ts, r.arrival.first) for r in temp.request_burst(df, 5, 20).collect()}
    assert got == expected and expected
    for stretch in (10, 20, 30):  # never shorter than the window
        assert {r.source_ip: tuple(r.begin) for r in temp.bursts(df, 5, 20, stretch).collect()} == expected


def test_dedup_is_the_sequential_fold(spark):
    rng = random.Random(5)
    rows, seen = [], {}
    for i in range(400):
        rows.append((rng.choice("AB"), rng.choice(["x", "y", None, ""]), rng.choice([None, "u"]), rng.randint(0, 6) * 10, [f"e{rng.randint(0, 30)}" for _ in range(rng.randint(0, 4))], rng.randint(1, 9), i))
    for kind, ip, user, score, evidence, count, _ in rows:
        key = (kind, ip or "", user or "")
        if key not in seen:
            seen[key] = [score, list(evidence), count]
            continue
        old = seen[key]
        if score > old[0]:
            seen[key] = [score, list(dict.fromkeys(evidence + old[1])), count]
        else:
            old[1] = list(dict.fromkeys(old[1] + evidence))
            old[2] = max(old[2], count)
    df = spark.createDataFrame(rows, "finding_type string, source_ip string, username string, severity_score int, evidence array<string>, count long, i long")
    df = conform(df.withColumn("detector_rank", F.lit(0)).withColumn("arrival", arrival(0, F.col("i"))), FINDING)
    got = {(r.finding_type, r.source_ip or "", r.username or ""): [r.severity_score, r.evidence, r["count"]] for r in fnd.dedup_findings(df.repartition(3)).collect()}
    assert got == {k: [s, list(dict.fromkeys(e))[:10], c] for k, (s, e, c) in seen.items()}


def test_each_signature_has_a_line(spark):
    from huntframe.fixtures import ATTACKS

    texts = [*ATTACKS[:9], "quiet", *ATTACKS[10:]]
    df = log(spark, [{"message": t, "user_agent": t, "http_path": "/wp-admin" if i == 9 else "/"} for i, t in enumerate(texts)])
    hits = {(r.seq, r.finding_type) for r in pattern_hits(df).collect()}
    assert {(i, s.name) for i, s in enumerate(SIGNATURES)} <= hits


def test_pattern_scores_rise_with_hits(spark):
    df = log(spark, [{"source_ip": "a", "message": "authentication failure"}] * 6 + [{"source_ip": "b", "message": "authentication failure"}] * 21 + [{"username": "c", "message": "authentication failure"}])
    got = {(r.source_ip, r.username): (r.severity_score, r["count"], len(r.evidence), r.description) for r in pattern_findings(df).collect()}
    assert got[("a", None)][:3] == (45, 6, 5) and got[("b", None)][:3] == (60, 21, 5)
    assert got[(None, "c")] == (35, 1, 1, "Authentication failure detected (1 event)")


def test_rate_error_bytes_and_paths(spark):
    calm = [{"source_ip": f"n{i}", "ts": START, "http_status": 200, "bytes_sent": 100, "http_path": "/"} for i in range(30)]
    busy = [{"source_ip": "hot", "ts": START, "http_status": 500, "bytes_sent": 100, "http_path": f"/{i}"} for i in range(130)]
    df = log(spark, [*calm, *busy, {"source_ip": "n0", "bytes_sent": 10**9}])
    spike = stat.request_rate_spike(df).collect()
    assert [(r.source_ip, r["count"], r.extra["max_rpm"]) for r in spike] == [("hot", 130, "130")]
    error = stat.error_rate_spike(df).collect()
    assert [(r["count"], r.severity_score, r.source_ip) for r in error] == [(160, 81, None)]
    assert [(r.source_ip, r.severity_score) for r in stat.large_response_bytes(df).collect()] == [("n0", 100)]
    assert [(r.source_ip, r["count"]) for r in stat.path_enumeration(df).collect()] == [("hot", 130)]


def test_auth_vocabularies_differ(spark):
    df = log(spark, [{"source_ip": "a", "process": "winlogon", "message": "Failed", "ts": START + timedelta(minutes=5 * i)} for i in range(12)] + [{"source_ip": "b", "process": "SSHD", "message": "account locked", "ts": START}] * 5 + [{"process": "pam_unix", "message": "failed", "ts": START}] * 9 + [{"event_id": "4625", "ts": START}] * 5)
    assert {r.key for r in stat.auth_failure_spike(df).collect()} == {"b", "unknown"}
    assert [(r.source_ip, r["count"], r.extra["duration_minutes"]) for r in temp.slow_brute_force(df).collect()] == [("a", 12, "55")]
    off = {r.key: r["count"] for r in temp.off_hours_auth_activity(df).collect()}
    assert off == {"a": 12, "b": 5, "unknown": 5}


def test_weekend_and_travel(spark):
    df = log(spark, [{"process": "useradd", "ts": START, "username": "u", "source_ip": "a"}, {"process": "useradd", "ts": START + timedelta(days=3), "username": "u", "source_ip": "a"}, {"ts": START + timedelta(minutes=5), "username": "u", "source_ip": "b"}])
    assert [(r.key, r.severity_score) for r in temp.weekend_sensitive_activity(df).collect()] == [("u", 38)]
    assert [(r.source_ip, r.extra["ip_a"], r.extra["delta_seconds"], r.evidence) for r in temp.impossible_travel(df).collect()] == [("b", "a", "300", ["line 0", "line 2"])]


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], FINDING)
    assert fnd.process_findings(none).count() == 0
    assert {r.severity: r.findings for r in fnd.severity_summary(none).collect()} == dict.fromkeys(("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"), 0)
    assert tuple(fnd.overall_risk(none).first()) == (0, "MINIMAL RISK")


def test_forest_finds_the_odd_source(spark):
    entries = [{"source_ip": f"s{i % 40}", "ts": START + timedelta(seconds=i), "http_path": f"/{i % 7}", "bytes_sent": 100 + i % 5, "http_status": 200} for i in range(800)]
    entries += [{"source_ip": "odd", "ts": START + timedelta(milliseconds=i), "http_path": f"/{i}", "bytes_sent": 10**6, "http_status": 500, "http_method": "POST", "user_agent": f"u{i}"} for i in range(200)]
    df = log(spark, entries)
    scores = {r.source: r.anomaly for r in isolation_forest_scores(df, trees=30).collect()}
    assert len(scores) == 41 and min(scores, key=scores.get) == "odd"
    assert scores == {r.source: r.anomaly for r in isolation_forest_scores(df.repartition(5), trees=30).collect()}
    flagged = ml_behavioural_anomaly(df, trees=30).collect()
    assert {r.source_ip: r.severity_score for r in flagged}["odd"] == 100 and len(flagged) <= 3
    assert isolation_forest_scores(df.filter("source_ip IN ('odd', 's1')"), trees=5).count() == 0
    assert average_path(2) == 1.0 and average_path(1) == 0.0


def crowd(spark):
    """One address (and user) holds all rows of an hour and is busy at its end, beside quiet ones."""
    rng = random.Random(12)
    base = datetime(2024, 1, 6, 3, tzinfo=timezone.utc)
    at = sorted(rng.randint(0, 3599) * 1_000_000 + rng.randint(0, 999_999) for _ in range(6000)) + [3599_900_000 + i for i in range(40)] + [3600_000_000 + i * 90_000 for i in range(60)]
    rows = [(i, base + timedelta(microseconds=t), "hot", "u", f"line {i}") for i, t in enumerate(at)]
    rows += [(10_000 + i, base + timedelta(seconds=300 * i), f"quiet{i % 3}", "v", "x") for i in range(40)]
    rows += [(20_000 + i, base + timedelta(seconds=61 * i), f"hop{i % 4}", "u", "x") for i in range(59)]
    return spark.createDataFrame(rows, "seq long, ts timestamp, source_ip string, username string, raw string")


@pytest.mark.parametrize(("events", "seconds"), [(20, 10), (2, 1), (9, 2), (60, 30)])
def test_bursts_in_a_crowd_are_the_same_however_it_is_cut(spark, events, seconds):
    log = crowd(spark)
    want = {r.source_ip: tuple(r.begin) for r in temp.bursts(log, events, seconds, 3600, 1 << 40).collect()}
    for stretch, most in ((3600, 100), (3600, 7), (1200, 300)):
        assert {r.source_ip: tuple(r.begin) for r in temp.bursts(log, events, seconds, stretch, most).collect()} == want


def test_travel_in_a_crowd_is_the_same_however_it_is_cut(spark):
    log = crowd(spark)
    read = lambda **how: sorted((r.ts, r.source_ip, r.extra["ip_a"], r.evidence) for r in temp.impossible_travel(log, 45, **how).collect())
    want = read(most=1 << 40)
    assert len(want) > 100 and read(most=100) == want == read(stretch=600, most=50)


def test_no_part_of_a_crowd_is_far_larger_than_the_others(spark):
    rows, _ = temp.in_stretches(crowd(spark).select("source_ip", "ts", "seq").filter("source_ip = 'hot'"), "source_ip", 10, 19, 3600, 300)
    sizes = sorted(r["count"] for r in rows.groupBy("source_ip", "chunk", "part").count().collect())
    assert len(sizes) > 15 and sizes[-1] <= 4 * sizes[len(sizes) // 2] and sum(sizes) < 1.5 * 6100
