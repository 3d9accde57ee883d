"""Syslog lines, both RFC forms, to entries; names and addresses are read from the message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.scalars import any_of, group_or_null, is_marked, map_of, marked, parted, right_trimmed
from huntframe.schema import LOG_ENTRY, conform

# The line formats, and what is looked for in messages. (?dU): character classes are Unicode's, and
# only a line feed ends a line.
RFC3164 = r"(?dU)^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\w[\w\-\.]*?)(?:\[(\d+)\])?:\s+(.+)$"
RFC5424 = r"(?dU)^<\d+>(?:\d+\s+)?(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)\s+(\S+)\s+(\S+)\s+(\S+)\s+\S+\s+\S+\s+(.+)$"
FAILED_LOGIN = r"(?dU)Failed (?:password|publickey) for (?:invalid user )?(\S+) from ([\d.]+)"
ACCEPTED_LOGIN = r"(?dU)Accepted (?:password|publickey) for (\S+) from ([\d.]+)"
INVALID_USER = r"(?dU)Invalid user (\S+) from ([\d.]+)"
SUDO = r"(?dU)sudo:\s+(\S+)\s+:.*COMMAND=(.+)"
SU_FAILED = r"(?dU)su: FAILED SU .* to (\S+) by (\S+)"
USER_ADDED = r"(?dU)new user: name=(\S+)"
USER_DELETED = r"(?dU)delete user '(\S+)'"
ANY_ADDRESS = r"(?dU)(?:from|src|source)\s+([\d.a-fA-F:]+)"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ERROR_WORDS = ("error", "failed", "failure", "denied", "invalid")


def level_of(message: Column) -> Column:
    """ERROR, WARNING or INFO by the words of a message."""
    low = F.lower(message)
    return F.when(any_of([F.contains(low, F.lit(w)) for w in ERROR_WORDS]), "ERROR").when(F.contains(low, F.lit("warn")), "WARNING").otherwise("INFO")


def enrichment(message: Column) -> dict[str, Column]:
    """User, address and extras that a message tells. Patterns later in the list overrule; a bare address counts only where none was named. A pattern is tried where the words are that it needs."""
    needs = {FAILED_LOGIN: "Failed ", ACCEPTED_LOGIN: "Accepted ", INVALID_USER: "Invalid user ", SUDO: "sudo:", SU_FAILED: "su: FAILED SU", USER_ADDED: "new user: name=", USER_DELETED: "delete user '"}
    there = lambda pattern: F.contains(message, F.lit(needs[pattern]))
    g = lambda pattern, i=1: F.when(there(pattern), group_or_null(message, pattern, i))
    flag = lambda pattern: F.when(there(pattern) & message.rlike(pattern), "true")
    return {
        "username": F.coalesce(g(SU_FAILED, 2), g(SUDO), g(INVALID_USER), g(ACCEPTED_LOGIN), g(FAILED_LOGIN)),
        "source_ip": F.coalesce(g(INVALID_USER, 2), g(ACCEPTED_LOGIN, 2), g(FAILED_LOGIN, 2), group_or_null(message, ANY_ADDRESS, 1)),
        "extra": map_of(failed_ssh=flag(FAILED_LOGIN), accepted_ssh=flag(ACCEPTED_LOGIN), invalid_user=flag(INVALID_USER), sudo_command=F.trim(g(SUDO, 2)), target_user=g(SU_FAILED), affected_user=F.coalesce(g(USER_DELETED), g(USER_ADDED))),
    }


def _rfc3164(p, year: Column) -> dict[str, Column]:
    month = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), p(0)), F.lit(0)), F.lit(1)).cast("int")
    clock = F.split(p(2), ":")
    number = lambda c: c.try_cast("int")
    local = F.try_make_timestamp_ntz(year, month, number(p(1)), number(F.get(clock, 0)), number(F.get(clock, 1)), number(F.get(clock, 2)).cast("decimal(16,6)"))
    return {"ts_local": local, "ts": local.cast("timestamp"), "hostname": p(3), "process": p(4), "pid": p(5).try_cast("int"), "message": p(6)}


def _rfc5424(p) -> dict[str, Column]:
    local = F.regexp_replace(p(0), r"(?:Z|[+-]\d{2}:\d{2})$", "")
    pid = F.when(p(3).rlike(r"^\d+$"), p(3).try_cast("int"))
    return {"ts_local": local.try_cast("timestamp_ntz"), "ts": p(0).try_cast("timestamp"), "hostname": p(1), "process": p(2), "pid": pid, "message": p(4)}


def syslog_form(raw: Column) -> Column:
    """Which line format parse_syslog reads a line by: 3164, 5424 or raw (kept as it is)."""
    return F.when(raw.rlike(RFC3164), "3164").when(raw.rlike(RFC5424), "5424").otherwise("raw")


def parse_syslog(lines: DataFrame, year: int | Column | None = None) -> DataFrame:
    """Entries of (seq, value). Comments and blank lines are skipped, others kept raw; an unknown month is January.

    RFC 3164 lines lack the year: it is given, else that in which the file was written (column `modified`), else the current one.
    """
    if year is None:
        year = F.year("modified") if "modified" in lines.columns else F.year(F.current_date())
    year = year if isinstance(year, Column) else F.lit(year)
    rows = lines.select("seq", right_trimmed(F.col("value")).alias("raw"), year.cast("int").alias("year")).filter("raw <> '' AND NOT startswith(raw, '#')")
    told = rows.withColumn("told", marked(F.col("raw"), RFC3164, 7))
    told = told.withColumn("told_new", F.when(~is_marked(F.col("told")), marked(F.col("raw"), RFC5424, 5)))
    split = told.select("seq", "raw", "year", parted(F.col("told")).alias("a"), parted(F.col("told_new")).alias("b"))
    a, b = _rfc3164(lambda i: F.get("a", i), F.col("year")), _rfc5424(lambda i: F.get("b", i))
    head = split.select("seq", "raw", (F.col("a").isNotNull() | F.col("b").isNotNull()).alias("parse_ok"), *(F.when(F.col("a").isNotNull(), a[c]).when(F.col("b").isNotNull(), b[c]).alias(c) for c in a))
    told = enrichment(F.col("message"))
    parsed = head.withColumns({c: F.when(F.col("parse_ok"), told[c]) for c in told} | {"log_level": F.when(F.col("parse_ok"), level_of(F.col("message")))})
    return conform(parsed.withColumn("message", F.coalesce("message", "raw")).withColumn("log_format", F.lit("syslog")), LOG_ENTRY)
