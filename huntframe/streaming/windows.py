"""The two tumbling counts on a stream of entries: append mode, by wall clock as in the batch jobs, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(log: DataFrame, late: str) -> DataFrame:
    """Entries with a time, watermarked by their wall clock. Streams carry an instant only, so it is read as if it were UTC."""
    return log.filter("ts IS NOT NULL").withColumn("wall", F.col("ts_local").cast("timestamp")).withWatermark("wall", late)


def stream_requests_per_minute(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(source_ip, minute, requests), each minute once it can no longer change."""
    counted = _timed(log.filter("source_ip <> ''"), late).groupBy("source_ip", F.window("wall", "1 minute")).agg(F.count("*").alias("requests"))
    return counted.select("source_ip", F.col("window.start").alias("minute"), "requests")


def stream_error_rate_windows(log: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """(window_start, total, errors, error_pct) of requests with a status."""
    counted = _timed(log.filter("http_status IS NOT NULL"), late).groupBy(F.window("wall", f"{minutes} minutes")).agg(F.count("*").alias("total"), F.count_if(F.col("http_status") >= 400).alias("errors"))
    return counted.select(F.col("window.start").alias("window_start"), "total", "errors", (F.col("errors") / F.col("total") * 100).alias("error_pct"))
