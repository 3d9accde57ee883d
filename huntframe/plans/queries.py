"""The registered log queries: each applies one operator to entries, or lines, derived from `events`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe import config
from huntframe.fixtures import events_log
from huntframe.functions import scalars
from huntframe.operators import findings as fnd
from huntframe.operators import statistical as stat
from huntframe.operators import temporal as temp
from huntframe.operators.evidence import evidence_top
from huntframe.operators.features import FEATURES, source_features, standardize_features
from huntframe.operators.forest import exact_quantile, isolation_forest_scores, ml_behavioural_anomaly
from huntframe.operators.keyed import keyed_findings
from huntframe.operators.parse_generic import parse_generic, route_generic, routed
from huntframe.operators.parse_syslog import parse_syslog, syslog_form
from huntframe.operators.parse_web import access_form, parse_access, status_level
from huntframe.operators.parse_windows import clean_address, clean_name, event_name, parse_windows
from huntframe.operators.signatures import SIGNATURES, pattern_findings, pattern_hits
from huntframe.operators.tags import mitre_tags
from huntframe.plans.analyse import ENABLED, analyse, detect
from huntframe.plans.lines import access_lines, generic_lines, syslog_lines, windows_lines
from huntframe.sources.lines import parse_logs, read_json_array, read_json_events, read_lines, run_stats
from huntframe.sources.scratch import kept, scratch
from huntframe.sources.sinks import list_runs, write_findings, write_run

YEAR = 2024
PLANTED = "6.6.6.6"
EVENTS_A_FILE = 5000  # of the arrays that are written: files grow in number with the table, not in size
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _named(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register an operator on the log of `events` under the function's name."""
    _queries[f.__name__] = lambda spark, sf_dir: f(events_log(spark, sf_dir))
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def _time(column: str = "ts") -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _brief(found: DataFrame, *more) -> DataFrame:
    return found.select("finding_type", "source_ip", "username", _time(), "severity_score", "severity", F.col("count"), *more)


# Sources and sinks


@_named
def read_lines_query(log: DataFrame) -> DataFrame:
    path = scratch(log.sparkSession, "lines")
    access_lines(log).select("value").write.text(path)
    return read_lines(log.sparkSession, path).groupBy("value").agg(F.count("*").alias("lines"))


@_named
def read_json_events_query(log: DataFrame) -> DataFrame:
    path = scratch(log.sparkSession, "events")
    windows_lines(log).select("value").write.text(path)
    return read_json_events(log.sparkSession, path).groupBy("event_id", "message", "parse_ok").agg(F.count("*").alias("entries"))


@_named
def read_json_array_query(log: DataFrame) -> DataFrame:
    path = scratch(log.sparkSession, "array")
    lines = windows_lines(log).filter(F.try_parse_json("value").isNotNull())  # an array holds JSON only
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda e: e["value"])
    by_file = lines.groupBy(F.floor(F.col("seq") / EVENTS_A_FILE).alias("part")).agg(F.concat(F.lit("["), F.array_join(in_order, ","), F.lit("]")).alias("value"))
    by_file.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return parse_windows(read_json_array(log.sparkSession, path)).groupBy("event_id", "message", "parse_ok").agg(F.count("*").alias("entries"))


@_named
def parse_logs_query(log: DataFrame) -> DataFrame:
    every = [parse_logs(lines(log), name, YEAR) for name, lines in (("apache", access_lines), ("syslog", syslog_lines), ("windows_event", windows_lines), ("other", generic_lines))]
    return fnd.reduce(DataFrame.unionByName, every).groupBy("log_format").agg(F.count("*").alias("entries"), F.count("username").alias("users"), F.count("source_ip").alias("addresses"))


@_named
def write_findings_query(log: DataFrame) -> DataFrame:
    path = scratch(log.sparkSession, "findings")
    found = kept(fnd.union_findings(stat.auth_failure_spike(log)))
    for _ in range(2):  # a run that is tried twice is there once
        write_findings(found, path, "run", "2024-01-31")
    return log.sparkSession.read.parquet(path).select("run_id", "finding_type", "source_ip", "severity_score", "count")


@_named
def run_stats_query(log: DataFrame) -> DataFrame:
    lines = access_lines(log)
    return run_stats(lines, parse_access(lines), "apache")


@_named
def run_stats_windows(log: DataFrame) -> DataFrame:
    lines = windows_lines(log)
    return run_stats(lines, parse_windows(lines), "windows_event")


@_named
def runs(log: DataFrame) -> DataFrame:
    """The record of a run, written and read back."""
    run = analyse(access_lines(log), "apache", enabled=("pattern", "statistical"))
    path = scratch(log.sparkSession, "runs")
    for _ in range(2):  # a run that is tried twice is there once
        write_run(run.stats, run.merged, path, "r1", run.detectors, "2024-01-31", run.seconds)
    return list_runs(log.sparkSession, path).select((F.col("analysis_duration_seconds") > 0).alias("timed"), "run_id", "run_date", "log_format", "total_lines", "parsed_lines", "parse_errors", F.array_join("detectors", ",").alias("detectors"))


def _run(lines: DataFrame, log_format: str, enabled: tuple[str, ...] = ("pattern", "statistical", "temporal")) -> DataFrame:
    found = analyse(lines, log_format, YEAR, enabled).findings
    return found.select("finding_type", "source_ip", "username", "severity_score", "severity", "count", F.contains("description", F.lit("[Corroborated by ")).alias("corroborated"))


@_named
def analyse_run_apache(log: DataFrame) -> DataFrame:
    """Lines to ranked findings by all detectors but the forest, whose scores hang on its random trees."""
    return _run(access_lines(log), "apache")


@_named
def analyse_run_syslog(log: DataFrame) -> DataFrame:
    return _run(syslog_lines(log), "syslog")


@_named
def analyse_run_windows(log: DataFrame) -> DataFrame:
    """All four families."""
    return _run(windows_lines(log), "windows_event", ENABLED)


@_named
def analyse_run_generic(log: DataFrame) -> DataFrame:
    """All four families."""
    return _run(generic_lines(log), "generic", ENABLED)


# Parse jobs


@_named
def parse_access_query(log: DataFrame) -> DataFrame:
    parsed = parse_access(access_lines(log)).filter(access_form(F.col("raw")) != "error")
    return parsed.select("seq", "source_ip", "username", _time(), "http_method", "http_path", "http_status", "bytes_sent", "user_agent", "message", F.col("extra")["protocol"].alias("protocol"), "parse_ok")


@_named
def parse_access_error(log: DataFrame) -> DataFrame:
    return parse_access(access_lines(log)).filter(access_form(F.col("raw")) == "error").select("seq", _time(), "log_level", "message", "parse_ok")


@_named
def access_status_level(log: DataFrame) -> DataFrame:
    return log.select("http_status", status_level(F.col("http_status")).alias("level")).groupBy("http_status", "level").agg(F.count("*").alias("entries"))


def _syslog(log: DataFrame, form: str) -> DataFrame:
    return parse_syslog(syslog_lines(log), YEAR).filter(syslog_form(F.col("raw")) == form)


@_named
def parse_syslog_3164(log: DataFrame) -> DataFrame:
    return _syslog(log, "3164").select("seq", _time(), "hostname", "process", "pid", "message")


@_named
def parse_syslog_5424(log: DataFrame) -> DataFrame:
    return _syslog(log, "5424").select("seq", _time(), "hostname", "process", "pid", "message")


@_named
def parse_syslog_raw(log: DataFrame) -> DataFrame:
    """The lines in neither form, which are kept raw."""
    return _syslog(log, "raw").select("seq", _time(), "hostname", "process", "pid", "message", "parse_ok")


@_named
def syslog_enrich(log: DataFrame) -> DataFrame:
    extra = F.col("extra")
    return parse_syslog(syslog_lines(log), YEAR).select("seq", "username", "source_ip", extra["failed_ssh"].alias("failed_ssh"), extra["target_user"].alias("target_user"), extra["affected_user"].alias("affected_user"))


@_named
def syslog_level(log: DataFrame) -> DataFrame:
    return parse_syslog(syslog_lines(log), YEAR).groupBy((F.col("seq") % 10).alias("form"), "log_level").agg(F.count("*").alias("entries"))


@_named
def parse_windows_query(log: DataFrame) -> DataFrame:
    return parse_windows(windows_lines(log)).select("seq", _time(), _time("ts_local"), "source_ip", "username", "hostname", "process", "event_id", "log_level", "message", "parse_ok")


@_named
def windows_event_name(log: DataFrame) -> DataFrame:
    code = (F.lit(4620) + F.col("seq") % 40).cast("string")
    return log.select(code.alias("event_id"), event_name(code, (F.col("seq") % 12).cast("string")).alias("name")).groupBy("event_id", "name").agg(F.count("*").alias("entries"))


@_named
def windows_clean_ip_user(log: DataFrame) -> DataFrame:
    at = F.col("seq") % 6
    ip = F.when(at == 0, "-").when(at == 1, "::1").when(at == 2, "127.0.0.1").otherwise(F.col("source_ip"))
    user = F.when(at == 0, "SYSTEM").when(at == 1, " - ").when(at == 2, "N/A").when(at == 3, "").otherwise(F.concat(F.lit(" "), "username"))
    return log.select("seq", clean_address(ip).alias("source_ip"), clean_name(user).alias("username"))


def _generic(log: DataFrame, route: str) -> DataFrame:
    return parse_generic(routed(generic_lines(log)).filter(F.col("route") == route).select("seq", F.col("raw").alias("value")))


@_named
def parse_generic_json(log: DataFrame) -> DataFrame:
    return _generic(log, "json").select("seq", _time(), "source_ip", "username", "http_path", "http_status", "bytes_sent", "log_level", F.col("extra")["zone"].alias("zone"))


@_named
def parse_generic_kv(log: DataFrame) -> DataFrame:
    return _generic(log, "kv").select("seq", _time(), "source_ip", "username", "http_path", "http_status", "bytes_sent", "log_level", "message", F.size("extra").alias("pairs"))


@_named
def parse_generic_text(log: DataFrame) -> DataFrame:
    """Text in which a request was found; all other text is in parse_generic_text_plain."""
    return _generic(log, "text").filter("http_method IS NOT NULL").select("seq", _time(), "source_ip", "username", "http_method", "http_path", "http_status", "log_level")


@_named
def parse_generic_text_plain(log: DataFrame) -> DataFrame:
    """Text in which no request was found."""
    return _generic(log, "text").filter("http_method IS NULL").select("seq", _time(), "source_ip", "username", "http_status", "log_level", "message")


@_named
def route_generic_query(log: DataFrame) -> DataFrame:
    return route_generic(generic_lines(log))


# Predicates and signatures


@_named
def pattern_hits_query(log: DataFrame) -> DataFrame:
    return pattern_hits(log).select("seq", "finding_type", "base_score")


def _pages_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    log = pages.select(F.col("page_id").alias("seq"), F.col("url").alias("http_path"), F.col("html").alias("message"), F.lit(None).cast("string").alias("user_agent"), F.lit(None).cast("string").alias("raw"))
    return pattern_hits(log).select("seq", "finding_type")


_queries["pattern_hits_pages"] = _pages_pattern_hits


@_named
def is_auth_failure(log: DataFrame) -> DataFrame:
    kinds = {"statistical": (config.FAILURE_WORDS_STATISTICAL, config.AUTH_PROCESSES_STATISTICAL), "temporal": (config.FAILURE_WORDS_TEMPORAL, config.AUTH_PROCESSES_TEMPORAL), "ml": (config.FAILURE_WORDS_ML, config.AUTH_PROCESSES_ML)}
    return log.select("seq", *(scalars.is_auth_failure(*words).alias(kind) for kind, words in kinds.items()))


@_named
def is_off_hours(log: DataFrame) -> DataFrame:
    return log.select("seq", scalars.is_off_hours(7, 20).alias("off_hours"))


@_named
def is_weekend_sensitive(log: DataFrame) -> DataFrame:
    return log.select("seq", scalars.is_weekend_sensitive().alias("weekend_sensitive"))


# Aggregations


@_named
def pattern_findings_query(log: DataFrame) -> DataFrame:
    return _brief(pattern_findings(log), F.size("evidence").alias("lines"))


@_named
def requests_per_minute(log: DataFrame) -> DataFrame:
    return stat.requests_per_minute(log).select("source_ip", _time("minute"), "requests")


@_named
def request_rate_spike(log: DataFrame) -> DataFrame:
    return _brief(stat.request_rate_spike(log), F.element_at("extra", "max_rpm").alias("max_rpm"))


@_named
def error_rate_windows(log: DataFrame) -> DataFrame:
    return stat.error_rate_windows(log).select(_time("window_start"), "total", "errors")


@_named
def error_rate_spike(log: DataFrame) -> DataFrame:
    return _brief(stat.error_rate_spike(log, error_rate_pct=20.0, minutes=60))


@_named
def large_response_bytes(log: DataFrame) -> DataFrame:
    return _brief(stat.large_response_bytes(log), F.element_at("extra", "bytes").cast("long").alias("bytes"))


@_named
def auth_failure_spike(log: DataFrame) -> DataFrame:
    return _brief(stat.auth_failure_spike(log), F.element_at("evidence", 1).alias("first_line"))


@_named
def path_enumeration(log: DataFrame) -> DataFrame:
    return _brief(stat.path_enumeration(log, zscore=2.0))


@_named
def path_enumeration_sketched(log: DataFrame) -> DataFrame:
    """By estimates far from the thresholds and counts near them: the same findings."""
    return _brief(stat.path_enumeration(log, zscore=2.0, sketched=True))


@_named
def off_hours_auth_activity(log: DataFrame) -> DataFrame:
    return _brief(temp.off_hours_auth_activity(log))


@_named
def weekend_sensitive_activity(log: DataFrame) -> DataFrame:
    return _brief(temp.weekend_sensitive_activity(log))


@_named
def slow_brute_force(log: DataFrame) -> DataFrame:
    return _brief(temp.slow_brute_force(log), F.element_at("extra", "duration_minutes").cast("long").alias("minutes"))


def _rounded_features(features: DataFrame) -> DataFrame:
    return features.select("source", *(F.round(c, 6).alias(c) if c not in ("total_requests", "unique_paths", "unique_user_agents", "auth_failures") else F.col(c) for c in FEATURES))


@_named
def source_features_query(log: DataFrame) -> DataFrame:
    return _rounded_features(source_features(log))


@_named
def source_features_sketched(log: DataFrame) -> DataFrame:
    """One pass, distinct paths and agents by sketches: no source here has so many that an estimate differs from the count."""
    return _rounded_features(source_features(log, sketched=True))


# Findings


def _some_findings(log: DataFrame) -> DataFrame:
    """Findings with many repeats of a key and differing scores, written once: what merging and correlation work on."""
    log = kept(log)
    return kept(fnd.union_findings(stat.large_response_bytes(log), stat.auth_failure_spike(log), temp.impossible_travel(log)))


@_named
def union_findings(log: DataFrame) -> DataFrame:
    return _brief(_some_findings(log), "detector", F.array_join("evidence", "|").alias("evidence"))


@_named
def dedup_findings(log: DataFrame) -> DataFrame:
    merged = fnd.dedup_findings(_some_findings(log))
    return _brief(merged, F.size("evidence").alias("lines"), F.array_join("evidence", "|").alias("evidence"))


@_named
def correlate_findings(log: DataFrame) -> DataFrame:
    suffix = F.regexp_extract("description", r"(?: \[Corroborated .*)?$", 0).alias("suffix")
    return _brief(fnd.correlate_findings(fnd.dedup_findings(_some_findings(log))), "detector", suffix, F.array_join("evidence", "|").alias("evidence"))


@_named
def rank_findings(log: DataFrame) -> DataFrame:
    return fnd.process_findings(_some_findings(log)).select("finding_type", "source_ip", "username", "severity_score")


@_named
def severity_summary(log: DataFrame) -> DataFrame:
    return fnd.severity_summary(_some_findings(log))


@_named
def severity_share(log: DataFrame) -> DataFrame:
    return fnd.severity_share(_some_findings(log))


@_named
def overall_risk(log: DataFrame) -> DataFrame:
    return fnd.overall_risk(_some_findings(log))


@_named
def top_source_ips(log: DataFrame) -> DataFrame:
    top = fnd.top_source_ips(_some_findings(log))
    return top.withColumn("finding_types", F.array_join("finding_types", ","))


@_named
def mitre_tags_query(log: DataFrame) -> DataFrame:
    return mitre_tags(_some_findings(log), SIGNATURES)


@_named
def finding_sentences(log: DataFrame) -> DataFrame:
    """What findings say and how they are tagged, word by word."""
    log = kept(log)
    keyed = keyed_findings(log, [stat.auth_rule(), temp.off_hours_rule(), temp.weekend_rule(), temp.slow_rule()])
    found = fnd.union_findings(keyed, temp.impossible_travel(log), temp.request_burst(log, events=3, seconds=3600))
    tags = F.array_join(F.transform("mitre_tags", lambda t: F.concat_ws(" / ", t["technique_id"], t["technique_name"], t["tactic"], t["url"])), ",")
    return found.select("detector", "finding_type", "source_ip", "username", "severity_score", "description", tags.alias("tags"))


@_named
def all_detectors(log: DataFrame) -> DataFrame:
    """Every detector but the forest, whose scores hang on its random trees."""
    return detect(kept(log), ("pattern", "statistical", "temporal")).groupBy("finding_type", "severity").agg(F.count("*").alias("findings"))


# Windows


@_named
def request_burst(log: DataFrame) -> DataFrame:
    return _brief(temp.request_burst(log, events=3, seconds=3600))


@_named
def request_burst_hot(log: DataFrame) -> DataFrame:
    """The same with stretches of another length."""
    return temp.bursts(log, events=3, seconds=3600, stretch=7200).select("source_ip", F.date_format("begin.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@_named
def impossible_travel(log: DataFrame) -> DataFrame:
    extra = F.col("extra")
    return _brief(temp.impossible_travel(log), extra["ip_a"].alias("ip_a"), extra["delta_seconds"].cast("int").alias("delta_seconds"))


@_named
def evidence_top5(log: DataFrame) -> DataFrame:
    return evidence_top(log, ["source_ip"], ["seq"]).select("source_ip", F.array_join("evidence", "|").alias("evidence"))


# Scalars


@_named
def format_duration(log: DataFrame) -> DataFrame:
    return log.select((F.col("seq") * 7).alias("seconds"), scalars.format_duration(F.col("seq") * 7).alias("text"))


@_named
def severity_of(log: DataFrame) -> DataFrame:
    score = (F.col("seq") % 101).cast("int")
    return log.select(score.alias("score"), scalars.severity_of(score).alias("severity")).groupBy("score", "severity").agg(F.count("*").alias("entries"))


# Learning


@_named
def standardize_features_query(log: DataFrame) -> DataFrame:
    return standardize_features(source_features(log)).select("source", *(F.round(c, 6).alias(c) for c in FEATURES))


@_named
def isolation_forest_scores_query(log: DataFrame) -> DataFrame:
    return isolation_forest_scores(log)


@_named
def ml_behavioural_anomaly_query(log: DataFrame) -> DataFrame:
    return _brief(ml_behavioural_anomaly(log), "description")


@_named
def response_quantiles(log: DataFrame) -> DataFrame:
    """Quantiles of response sizes, exact without a global sort: what the forest's cut is made by."""
    sizes = log.filter("bytes_sent > 0")
    found = [(share, round(exact_quantile(sizes, "bytes_sent", share, room=500), 6)) for share in (0.05, 0.5, 0.999)]
    return log.sparkSession.createDataFrame(found, "share double, bytes double")


@_named
def forest_properties(log: DataFrame) -> DataFrame:
    """What must hold of the forest whatever its random trees: every source of enough entries has a score within bounds, a planted source is the oddest and is flagged, and so is the share asked for, no more."""
    odd = log.filter("seq % 10 = 0").withColumns({"seq": F.col("seq") + F.lit(1 << 40), "source_ip": F.lit(PLANTED), "http_path": F.concat(F.lit("/x/"), "seq"), "http_status": F.lit(500), "bytes_sent": F.col("bytes_sent") * 1000, "user_agent": F.concat(F.lit("odd"), "seq")})
    planted = kept(log.unionByName(odd))
    scores, found = kept(isolation_forest_scores(planted)), kept(ml_behavioural_anomaly(planted))
    scored = scores.agg(F.count("*").alias("sources"), F.count_if(F.col("anomaly").between(-1, 0)).alias("in_bounds"), F.min_by("source", "anomaly").alias("oddest"))
    worst = F.max_by(F.struct("source_ip", "severity_score", "severity"), "severity_score")
    flagged = found.agg(F.count("*").alias("flagged"), F.count_if(F.col("severity_score").between(25, 100)).alias("scored"), F.count_if(F.size("evidence") > 0).alias("with_lines"), worst.alias("worst"))
    return scored.crossJoin(F.broadcast(flagged)).select("sources", "in_bounds", "oddest", "flagged", "scored", "with_lines", F.col("worst.source_ip").alias("worst"), F.col("worst.severity_score").alias("severity_score"), F.col("worst.severity").alias("severity"))


for _name in [n for n in _queries if n.endswith("_query")]:
    _queries[_name.removesuffix("_query")] = _queries.pop(_name)
