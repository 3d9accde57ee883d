"""Web access and error log lines to entries: one projection, no shuffle. A line is matched once by each form that is tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.scalars import is_marked, map_of, marked, parted, right_trimmed
from huntframe.schema import LOG_ENTRY, conform

# The line formats. (?dU): character classes are Unicode's, and only a line feed ends a line.
ACCESS = r'(?dU)^([\d.a-fA-F:]+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*?)"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)")?(?:\s+"([^"]*)")?'
ERROR = r"(?dU)^\[([^\]]+)\]\s+\[(\w+)\]\s+(?:\[pid \d+\]\s+)?(.+)$"
ACCESS_TIME = "dd/MMM/yyyy:HH:mm:ss"
_WHOLE_ACCESS = ACCESS + r"(?s:.*)$"  # what follows the known groups is matched too, so that the groups alone are left


def status_level(status: Column) -> Column:
    """ERROR from 500, WARNING from 400, else INFO; null is INFO."""
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").otherwise("INFO")


def access_form(raw: Column) -> Column:
    """Which line format parse_access reads a line by: access, error or raw (kept as it is)."""
    return F.when(raw.rlike(ACCESS), "access").when(raw.rlike(ERROR), "error").otherwise("raw")


def parse_access(lines: DataFrame) -> DataFrame:
    """Entries of (seq, value): access format, else error format, else kept raw with parse_ok false. Blank lines are skipped.

    Of an error line's time, what stands after its last dot is dropped, the year included, so only times without a fraction parse.
    """
    rows = lines.select("seq", right_trimmed(F.col("value")).alias("raw")).filter("raw <> ''")
    told = rows.withColumn("told", marked(F.col("raw"), _WHOLE_ACCESS, 9))
    told = told.withColumn("told_error", F.when(~is_marked(F.col("told")), marked(F.col("raw"), ERROR, 3)))
    split = told.select("seq", "raw", parted(F.col("told")).alias("a"), parted(F.col("told_error")).alias("e"))
    a, e = F.col("a"), F.col("e")
    time = F.trim(F.get(a, 3))
    of_error = F.regexp_replace(F.get(e, 0), r"\.[^.]*$", "")
    plain = F.when(of_error.rlike(r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) "), F.regexp_replace(F.substr(of_error, F.lit(5)), r"\s+", " "))
    dated = split.select(
        "*",
        F.split(F.get(a, 4), " ", 3).alias("words"),
        F.get(a, 5).try_cast("int").alias("http_status"),
        F.coalesce(F.try_to_timestamp(time, F.lit(f"{ACCESS_TIME} Z")), F.try_to_timestamp(plain, F.lit("MMM d HH:mm:ss yyyy"))).alias("ts"),
        F.substring(time, 1, 20).alias("clock"),
    )
    words, count = F.col("words"), F.size("words")
    filled = lambda i: F.nullif(F.get(a, i), F.lit(""))
    parsed = dated.select(
        "seq",
        "raw",
        "ts",
        F.when(F.col("ts").isNotNull(), F.coalesce(F.try_to_timestamp("clock", F.lit(ACCESS_TIME)), "ts")).cast("timestamp_ntz").alias("ts_local"),
        F.get(a, 0).alias("source_ip"),
        F.nullif(F.get(a, 2), F.lit("-")).alias("username"),
        F.coalesce(F.get(a, 4), F.get(e, 2), "raw").alias("message"),
        F.when(count >= 2, F.get(words, 0)).alias("http_method"),
        F.when(count >= 2, F.get(words, 1)).otherwise(F.get(words, 0)).alias("http_path"),
        "http_status",
        F.when(F.get(a, 6).rlike(r"^\d+$"), F.get(a, 6).try_cast("long")).alias("bytes_sent"),
        filled(8).alias("user_agent"),
        F.when(a.isNotNull(), status_level(F.col("http_status"))).otherwise(F.upper(F.get(e, 1))).alias("log_level"),
        F.when(a.isNotNull(), map_of(referrer=filled(7), protocol=F.when(count >= 3, F.get(words, 2)))).alias("extra"),
        F.lit("apache").alias("log_format"),
        (a.isNotNull() | e.isNotNull()).alias("parse_ok"),
    )
    return conform(parsed, LOG_ENTRY)
