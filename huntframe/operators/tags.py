"""Technique tags of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def technique_url(technique_id: str) -> str:
    """A technique's address; a sub-technique's dot is a slash there."""
    return f"https://attack.mitre.org/techniques/{technique_id.replace('.', '/')}/"


def tag(technique_id: str, name: str, tactic: str) -> Column:
    """One tag."""
    return F.struct(F.lit(technique_id).alias("technique_id"), F.lit(name).alias("technique_name"), F.lit(tactic).alias("tactic"), F.lit(technique_url(technique_id)).alias("url"))


# The technique of each finding that is no signature hit.
TECHNIQUES = {
    "request_rate_spike": ("T1110", "Brute Force", "Credential Access"),
    "error_rate_spike": ("T1595", "Active Scanning", "Reconnaissance"),
    "large_response_bytes": ("T1030", "Data Transfer Size Limits", "Exfiltration"),
    "auth_failure_spike": ("T1110.001", "Password Guessing", "Credential Access"),
    "path_enumeration": ("T1595.003", "Wordlist Scanning", "Reconnaissance"),
    "off_hours_auth_activity": ("T1078", "Valid Accounts", "Initial Access"),
    "request_burst": ("T1498", "Network Denial of Service", "Impact"),
    "impossible_travel": ("T1078", "Valid Accounts", "Initial Access"),
    "weekend_sensitive_activity": ("T1098", "Account Manipulation", "Persistence"),
    "slow_brute_force": ("T1110.003", "Password Spraying", "Credential Access"),
    "ml_behavioural_anomaly": ("T1595", "Active Scanning", "Reconnaissance"),
}


def technique_table(spark, signatures: tuple) -> DataFrame:
    """(finding_type, technique_id, technique_name, tactic, url): the dimension that findings join."""
    rows = [(s.name, *t) for s in signatures for t in s.tags] + [(name, *t) for name, t in TECHNIQUES.items()]
    table = spark.createDataFrame(rows, "finding_type string, technique_id string, technique_name string, tactic string")
    return table.withColumn("url", F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace("technique_id", F.lit("."), F.lit("/")), F.lit("/")))


def mitre_tags(findings: DataFrame, signatures: tuple) -> DataFrame:
    """One row per finding type and technique with the number of findings; the dimension is a few rows, broadcast."""
    counts = findings.groupBy("finding_type").agg(F.count("*").alias("findings"))
    return counts.join(F.broadcast(technique_table(findings.sparkSession, signatures)), "finding_type")
