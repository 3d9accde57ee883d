"""Rate, share and size outliers: everything is grouped first, and only flagged groups fetch their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe import config
from huntframe.config import DEFAULTS, SENTENCES
from huntframe.functions.scalars import ADDRESS_FIRST, bounded_score, is_auth_failure, map_of, severity_of
from huntframe.operators.evidence import claim, fetch_evidence, with_evidence
from huntframe.operators.features import SKETCH
from huntframe.operators.keyed import WIDTH, KeyedRule, keyed_findings, quoted
from huntframe.operators.tags import TECHNIQUES, tag
from huntframe.schema import arrival
from huntframe.sources.scratch import once

DETECTOR = "Statistical Detector"


def finding(grouped: DataFrame, detector: str, detector_rank: int, rule_rank: int, kind: str, score: Column, description: Column, extra: Column | None = None) -> DataFrame:
    """grouped with the columns that all findings share. grouped brings source_ip, username, ts, count, first_seq."""
    return (
        grouped.withColumn("detector", F.lit(detector))
        .withColumn("finding_type", F.lit(kind))
        .withColumn("severity_score", bounded_score(score))
        .withColumn("severity", severity_of(F.col("severity_score")))
        .withColumn("description", description)
        .withColumn("mitre_tags", F.array(tag(*TECHNIQUES[kind])))
        .withColumn("extra", extra if extra is not None else F.lit(None).cast("map<string,string>"))
        .withColumn("detector_rank", F.lit(detector_rank))
        .withColumn("arrival", arrival(rule_rank, F.col("first_seq")))
    )


def sentence(kind: str, *parts) -> Column:
    return F.format_string(SENTENCES[kind], *(F.col(p) if isinstance(p, str) else p for p in parts))


def spread(values: DataFrame, column: str) -> DataFrame:
    """One row: n, mean and population deviation, from exact whole sums so that task order cannot show."""
    x = F.col(column).cast("decimal(38,0)")
    sums = values.agg(F.count(column).alias("n"), F.sum(x).alias("s"), F.sum((x * x).cast("decimal(38,0)")).alias("q"))
    n, s, q = (F.col(c).cast("double") for c in "nsq")
    variance = F.greatest((n * q - s * s) / (n * n), F.lit(0.0))
    return sums.select("n", F.when(F.col("n") > 0, s / n).alias("mean"), F.when(F.col("n") > 0, F.sqrt(variance)).alias("std"))


def zscored(values: DataFrame, column: str) -> DataFrame:
    """values with n, mean, std and z (0 where nothing varies); the one-row statistics are broadcast."""
    z = F.when(F.col("std") > 0, (F.col(column) - F.col("mean")) / F.col("std")).otherwise(0.0)
    return values.crossJoin(F.broadcast(spread(values, column))).withColumn("z", z)


def requests_per_minute(log: DataFrame) -> DataFrame:
    """(source_ip, minute, requests) by wall clock."""
    return log.filter("source_ip <> '' AND ts IS NOT NULL").groupBy("source_ip", F.date_trunc("minute", "ts_local").alias("minute")).agg(F.count("*").alias("requests"))


def _first_entries(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """The first entry's place and time of each flagged address."""
    return rows.join(flagged.select("source_ip"), "source_ip", "left_semi").groupBy("source_ip").agg(F.min("seq").alias("first_seq"), F.min_by("ts", "seq").alias("ts"))


def rate_claims(log: DataFrame, requests_per_minute_least: int = DEFAULTS.requests_per_minute, zscore: float = DEFAULTS.zscore) -> DataFrame:
    """request_rate_spike without its lines."""
    busiest = requests_per_minute(log).groupBy("source_ip").agg(F.max("requests").alias("max_rpm"), F.sum("requests").alias("count"))
    flagged = zscored(busiest, "max_rpm").filter((F.col("max_rpm") >= requests_per_minute_least) | (F.col("z") >= zscore))
    found = flagged.join(_first_entries(log.filter("source_ip <> ''"), flagged), "source_ip").withColumn("username", F.lit(None).cast("string"))
    text = sentence("request_rate_spike", "source_ip", "max_rpm", "z", F.lit(requests_per_minute_least))
    return claim(finding(found, DETECTOR, 1, 1, "request_rate_spike", 40 + (F.col("z") * 10).cast("int"), text, map_of(max_rpm=F.col("max_rpm"), z_score=F.round("z", 2))))


def request_rate_spike(log: DataFrame, requests_per_minute_least: int = DEFAULTS.requests_per_minute, zscore: float = DEFAULTS.zscore) -> DataFrame:
    """Addresses whose busiest minute reaches the threshold or stands out among all addresses."""
    return fetch_evidence(rate_claims(log, requests_per_minute_least, zscore), log)


def error_rate_windows(log: DataFrame, minutes: int = DEFAULTS.error_window_minutes) -> DataFrame:
    """(window_start, total, errors, error_pct) over tumbling wall-clock windows of requests with a status."""
    start = F.window("ts_local", f"{minutes} minutes")["start"]
    counted = log.filter("http_status IS NOT NULL AND ts IS NOT NULL").groupBy(start.alias("window_start")).agg(F.count("*").alias("total"), F.count_if(F.col("http_status") >= 400).alias("errors"), F.min("seq").alias("first_seq"), F.min_by("ts", "seq").alias("ts"))
    return counted.withColumn("error_pct", F.col("errors") / F.col("total") * 100)


def error_rate_spike(log: DataFrame, error_rate_pct: float = DEFAULTS.error_rate_pct, least: int = DEFAULTS.error_window_least, minutes: int = DEFAULTS.error_window_minutes) -> DataFrame:
    """Windows with enough requests of which too many failed."""
    found = error_rate_windows(log, minutes).filter((F.col("total") >= least) & (F.col("error_pct") >= error_rate_pct))
    found = found.withColumn("count", F.col("total")).withColumn("source_ip", F.lit(None).cast("string")).withColumn("username", F.lit(None).cast("string"))
    window = F.date_format("window_start", "yyyy-MM-dd HH:mm")
    text = sentence("error_rate_spike", "error_pct", window, "errors", "total")
    found = finding(found, DETECTOR, 1, 2, "error_rate_spike", F.col("error_pct").cast("int"), text, map_of(error_pct=F.round("error_pct", 1), window=window))
    rows = log.filter("http_status IS NOT NULL AND ts IS NOT NULL").withColumn("window_start", F.window("ts_local", f"{minutes} minutes")["start"])
    return with_evidence(found, rows, ["window_start"], ["seq"])


def large_response_bytes(log: DataFrame, zscore: float = DEFAULTS.zscore, least_rows: int = DEFAULTS.bytes_least_rows) -> DataFrame:
    """Responses far larger than the rest; nothing below least_rows responses."""
    sized = zscored(log.filter("bytes_sent > 0"), "bytes_sent").filter((F.col("n") >= least_rows) & (F.col("std") > 0) & (F.col("z") >= zscore))
    found = sized.select("source_ip", F.lit(None).cast("string").alias("username"), "ts", F.lit(1).cast("long").alias("count"), F.col("seq").alias("first_seq"), "bytes_sent", "mean", "z", F.array(F.substring("raw", 1, WIDTH)).alias("evidence"))
    text = sentence("large_response_bytes", "bytes_sent", "z", "mean")
    return finding(found, DETECTOR, 1, 3, "large_response_bytes", 45 + (F.col("z") * 8).cast("int"), text, map_of(bytes=F.col("bytes_sent"), z_score=F.round("z", 2), mean_bytes=F.round("mean", 0)))


def auth_rule(auth_failures: int = DEFAULTS.auth_failures) -> KeyedRule:
    """Sources with many authentication failures."""
    return KeyedRule(
        name="auth_failure_spike",
        meets=is_auth_failure(config.FAILURE_WORDS_STATISTICAL, config.AUTH_PROCESSES_STATISTICAL),
        key=ADDRESS_FIRST,
        enough=f"count >= {auth_failures}",
        score="35 + least(count, 60)",
        text=f"format_string({quoted(SENTENCES['auth_failure_spike'])}, count, key)",
        tags=(TECHNIQUES["auth_failure_spike"],),
        detector=DETECTOR,
        detector_rank=1,
        rule_rank=4,
        extra="map('fail_count', cast(count AS string), 'source', key)",
    )


def auth_failure_spike(log: DataFrame, auth_failures: int = DEFAULTS.auth_failures) -> DataFrame:
    """Sources with many authentication failures."""
    return keyed_findings(log, [auth_rule(auth_failures)])


#: How far below a threshold counts are made exact, as a share of it.
NEAR = 0.1


def _path_counts(rows: DataFrame, zscore: float, unique_paths: int, sketched: bool) -> DataFrame:
    """(source_ip, count): distinct paths. Exactly: pairs are made distinct before they are counted, so every pair is shuffled.

    sketched: a sketch of each address is merged instead, and only addresses that come near both thresholds are counted
    exactly, so that no pair of any other address is shuffled. The mean and deviation are of exact counts for those, of estimates for the rest.
    """
    exactly = lambda some, name: some.select("source_ip", "http_path").distinct().groupBy("source_ip").agg(F.count("*").alias(name))
    if not sketched:
        return exactly(rows, "count")
    about = once(rows.groupBy("source_ip").agg(F.hll_sketch_estimate(F.hll_sketch_agg("http_path", F.lit(SKETCH))).alias("count")))
    close = lambda least: F.lit(least - NEAR * abs(least))
    near = zscored(about, "count").filter((F.col("z") >= close(zscore)) & (F.col("count") >= close(unique_paths)))
    exact = exactly(rows.join(near.select("source_ip"), "source_ip", "left_semi"), "exact")
    return about.join(exact, "source_ip", "left").select("source_ip", F.coalesce("exact", "count").alias("count"))


def path_claims(log: DataFrame, zscore: float = DEFAULTS.zscore, unique_paths: int = DEFAULTS.unique_paths, sketched: bool = False) -> DataFrame:
    """path_enumeration without its lines."""
    rows = log.filter("source_ip <> '' AND http_path <> ''")
    paths = _path_counts(rows, zscore, unique_paths, sketched)
    flagged = zscored(paths, "count").filter((F.col("z") >= zscore) & (F.col("count") >= unique_paths))
    found = flagged.join(_first_entries(rows, flagged), "source_ip").withColumn("username", F.lit(None).cast("string"))
    text = sentence("path_enumeration", "source_ip", "count", "z")
    return claim(finding(found, DETECTOR, 1, 5, "path_enumeration", 40 + (F.col("z") * 8).cast("int"), text, map_of(unique_paths=F.col("count"), z_score=F.round("z", 2))))


def path_enumeration(log: DataFrame, zscore: float = DEFAULTS.zscore, unique_paths: int = DEFAULTS.unique_paths, sketched: bool = False) -> DataFrame:
    """Addresses that ask for many more distinct paths than the others; sketched: with estimates for those far from the thresholds."""
    return fetch_evidence(path_claims(log, zscore, unique_paths, sketched), log, with_paths=("path_enumeration",))
