"""Thresholds and word lists of the detectors, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


# The thresholds' defaults.
@dataclass(frozen=True)
class Thresholds:
    """Every number a detector compares with. Pass a changed copy (dataclasses.replace) to tune one."""

    zscore: float = 3.0
    requests_per_minute: int = 120
    error_rate_pct: float = 40.0
    error_window_minutes: int = 5
    error_window_least: int = 10
    bytes_least_rows: int = 20
    auth_failures: int = 5
    unique_paths: int = 20
    day_begins: int = 7
    day_ends: int = 20
    off_hours_events: int = 2
    burst_events: int = 20
    burst_seconds: int = 10
    travel_seconds: int = 300
    slow_failures: int = 10
    slow_minutes: int = 30
    forest_trees: int = 100
    forest_sample: int = 256
    contamination: float = 0.05
    forest_least_sources: int = 5
    forest_least_events: int = 3


DEFAULTS = Thresholds()

# Which words and processes mean what, as each family of detectors reads them.
FAILURE_WORDS_STATISTICAL = ("failed", "failure", "invalid", "error", "denied", "locked")
FAILURE_WORDS_TEMPORAL = ("failed", "failure", "invalid", "denied", "error")
FAILURE_WORDS_ML = ("failed", "failure", "invalid", "denied")
AUTH_PROCESSES_STATISTICAL = ("sshd", "su", "sudo", "login", "passwd", "pam", "krb5", "kerberos")
AUTH_PROCESSES_TEMPORAL = ("sshd", "su", "sudo", "login", "passwd", "pam", "krb5", "kerberos", "winlogon")
AUTH_PROCESSES_ML = ("sshd", "su", "sudo", "login", "passwd", "pam")
SENSITIVE_PROCESSES = ("useradd", "userdel", "usermod", "passwd", "visudo", "crontab", "at", "systemctl", "service")
FAILED_LOGON_EVENT = "4625"
OFF_HOURS_EVENTS = ("4624", "4625", "4648", "4672", "4720", "4726")
WEEKEND_EVENTS = ("4720", "4726", "4698", "7045", "1102", "4719")

# Lowest score of each severity, highest first, and each severity's weight in the overall risk.
SEVERITIES = (("CRITICAL", 80), ("HIGH", 50), ("MEDIUM", 25), ("LOW", 0))
RISK_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.7, "MEDIUM": 0.4, "LOW": 0.15, "INFO": 0.0}
RISK_LABELS = (("CRITICAL RISK", 80), ("HIGH RISK", 60), ("MEDIUM RISK", 35), ("LOW RISK", 10), ("MINIMAL RISK", 0))

# The sentence of each finding (a signature's is its own description), and those that a source's habits add.
SENTENCES = {
    "request_rate_spike": "IP %s sent %d requests/minute (Z-score: %.1f, threshold: %d RPM). Possible brute force or DDoS.",
    "error_rate_spike": "%.0f%% error rate in window %s (%d/%d requests). May indicate scanning, attack, or application failure.",
    "large_response_bytes": "Unusually large response: %,d bytes (Z-score: %.1f, mean: %,.0f). Possible data exfiltration or misconfiguration.",
    "auth_failure_spike": "%d authentication failures from %s. Possible brute force or credential stuffing.",
    "path_enumeration": "IP %s accessed %d unique paths (Z-score: %.1f). Consistent with directory/content scanning.",
    "off_hours_auth_activity": "%d authentication/sensitive events outside business hours (%02d:00–%02d:00) from %s.",
    "request_burst": "IP %s sent %d requests in %d seconds. Possible DDoS, brute force, or automated scanner.",
    "impossible_travel": "User '%s' active from %s then %s within %d seconds. Possible account sharing, credential theft, or VPN switch.",
    "weekend_sensitive_activity": "%d sensitive operations on a weekend by %s. User account changes, service installs, or audit policy changes outside working days warrant investigation.",
    "slow_brute_force": "%d auth failures from %s spread over %s. Low-rate brute force designed to evade rate-limit detection.",
    "ml_behavioural_anomaly": "ML anomaly detected for source %s (anomaly score: %d/100).",
    "corroborated": " [Corroborated by %d detectors — score boosted]",
}
HABITS = (
    ("unique_paths", 50, "Accessed %d unique paths."),
    ("error_rate_pct", 30, "High error rate: %.0f%%."),
    ("rpm", 60, "High request rate: %.0f RPM."),
    ("auth_failures", 3, "%d authentication failures."),
    ("off_hours_pct", 50, "%.0f%% of activity outside business hours."),
    ("unique_user_agents", 5, "%d distinct user agents (possible rotation)."),
)
