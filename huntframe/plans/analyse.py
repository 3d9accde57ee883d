"""The whole hunt: entries to findings to a ranked, summarised run."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from huntframe.config import DEFAULTS, Thresholds
from huntframe.operators import findings as fnd
from huntframe.operators import statistical as stat
from huntframe.operators import temporal as temp
from huntframe.operators.evidence import fetch_evidence
from huntframe.operators.forest import ml_claims
from huntframe.operators.keyed import keyed_findings
from huntframe.operators.signatures import SIGNATURES, searched, signature_rules
from huntframe.sources.lines import parse_logs, run_stats
from huntframe.sources.scratch import collected, discard, kept

ENABLED = ("pattern", "statistical", "ml", "temporal")
#: How each family is called in a run's record.
CALLED = {"pattern": "Pattern", "statistical": "Statistical", "ml": "ML", "temporal": "Temporal"}


def detect(log: DataFrame, enabled: tuple[str, ...] = ENABLED, thresholds: Thresholds = DEFAULTS, signatures: tuple = SIGNATURES) -> DataFrame:
    """Raw findings of the enabled families.

    What the detectors share is done once: all rules that judge an entry by itself in one pass, and the evidence
    of all findings about addresses in another. log is read about ten times, a few columns at a time: give a
    table on disk (`kept`), not a plan that is dear to work out.
    """
    t = thresholds
    rules, claims, others = [], [], []
    if "pattern" in enabled:
        log_searched = searched(log, signatures)
        rules += signature_rules(signatures)
    else:
        log_searched = log
    if "statistical" in enabled:
        rules.append(stat.auth_rule(t.auth_failures))
        claims += [stat.rate_claims(log, t.requests_per_minute, t.zscore), stat.path_claims(log, t.zscore, t.unique_paths)]
        others += [stat.error_rate_spike(log, t.error_rate_pct, t.error_window_least, t.error_window_minutes), stat.large_response_bytes(log, t.zscore, t.bytes_least_rows)]
    if "ml" in enabled:
        claims.append(ml_claims(log, t.contamination, trees=t.forest_trees, sample=t.forest_sample, least_sources=t.forest_least_sources))
    if "temporal" in enabled:
        rules += [temp.off_hours_rule(t.day_begins, t.day_ends, t.off_hours_events), temp.weekend_rule(), temp.slow_rule(t.slow_failures, t.slow_minutes)]
        claims.append(temp.burst_claims(log, t.burst_events, t.burst_seconds))
        others.append(temp.impossible_travel(log, t.travel_seconds))
    if rules:
        others.append(keyed_findings(log_searched, rules))
    if claims:
        claimed = kept(fnd.union_claims(*claims))
        others.append(fetch_evidence(claimed, log, with_paths=("path_enumeration",), by_time=("request_burst",)))
    return fnd.union_findings(*others) if others else log.sparkSession.createDataFrame([], fnd.FINDING)


@dataclass
class Run:
    """What one analysis gives. entries, raw and merged are tables in the shared folder; `close` removes them."""

    entries: DataFrame
    raw: DataFrame
    merged: DataFrame
    stats: DataFrame
    detectors: tuple[str, ...]
    seconds: float  # from the first line read to the last finding written

    @property
    def findings(self) -> DataFrame:
        """Merged and correlated findings, ranked: the one global sort, over findings only."""
        return fnd.rank_findings(self.merged)

    @property
    def summary(self) -> DataFrame:
        return fnd.severity_summary(self.merged)

    @property
    def top_sources(self) -> DataFrame:
        return fnd.top_source_ips(self.merged)

    @property
    def risk(self) -> DataFrame:
        return fnd.overall_risk(self.merged)

    def close(self) -> None:
        discard(self.entries, self.raw, self.merged)


def analyse(lines: DataFrame, log_format: str, year: int | Column | None = None, enabled: tuple[str, ...] = ENABLED, thresholds: Thresholds = DEFAULTS, signatures: tuple = SIGNATURES) -> Run:
    """Parse (seq, value) lines and hunt in them. The jobs run here: entries, raw findings and merged findings are each written once and read by all that follows."""
    began = time.monotonic()
    entries = kept(parse_logs(lines, log_format, year))
    with collected() as passing:
        raw = kept(detect(entries, enabled, thresholds, signatures))
    discard(*(t for t in passing if t is not raw))
    with collected() as passing:
        merged = kept(fnd.correlate_findings(fnd.dedup_findings(raw)))
    discard(*(t for t in passing if t is not merged))
    used = tuple(CALLED[f] for f in ENABLED if f in enabled)
    return Run(entries, raw, merged, run_stats(lines, entries, log_format), used, round(time.monotonic() - began, 3))
