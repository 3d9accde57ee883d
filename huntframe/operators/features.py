"""Behaviour of each source as nine numbers, and their standard form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe import config
from huntframe.config import DEFAULTS
from huntframe.functions.scalars import first_filled, is_auth_failure, is_off_hours

#: log2 of the cells of a sketch of distinct values: by its design, up to about 1,500 values of a source are as good as counted, more are 0.8 % off as a rule.
SKETCH = 14
FEATURES = ("total_requests", "unique_paths", "error_rate_pct", "avg_bytes", "unique_user_agents", "rpm", "auth_failures", "off_hours_pct", "post_ratio_pct")


def source_features(log: DataFrame, least: int = DEFAULTS.forest_least_events, day_begins: int = DEFAULTS.day_begins, day_ends: int = DEFAULTS.day_ends, sketched: bool = False) -> DataFrame:
    """One row per source of at least `least` entries. Distinct paths and agents are counted in passes of their own, so no row is multiplied.

    sketched: they are estimated in the one pass over everything else, without a shuffle of pairs (see SKETCH for the error).
    """
    keyed = log.withColumn("source", first_filled("source_ip"))
    timed = F.col("ts").isNotNull()
    about = lambda c, name: F.hll_sketch_estimate(F.hll_sketch_agg(F.nullif(c, F.lit("")), F.lit(SKETCH))).alias(name)
    estimates = [about("http_path", "unique_paths"), about("user_agent", "unique_user_agents")] if sketched else []
    base = keyed.groupBy("source").agg(
        *estimates,
        F.count("*").alias("total_requests"),
        F.count_if(F.col("http_status") >= 400).alias("errors"),
        F.sum(F.nullif("bytes_sent", F.lit(0))).alias("bytes_sum"),
        F.count(F.nullif("bytes_sent", F.lit(0))).alias("bytes_n"),
        F.count("ts").alias("timed"),
        F.min("ts").alias("begins"),
        F.max("ts").alias("ends"),
        F.count_if(is_auth_failure(config.FAILURE_WORDS_ML, config.AUTH_PROCESSES_ML)).alias("auth_failures"),
        F.count_if(timed & is_off_hours(day_begins, day_ends)).alias("off_hours"),
        F.count_if(F.col("http_method") == "POST").alias("posts"),
        F.min("seq").alias("first_seq"),
        F.min_by("ts", "seq").alias("ts"),
    )
    base = base.filter(F.col("total_requests") >= least)
    distinct = lambda c, name: keyed.filter(F.col(c) != "").select("source", c).distinct().groupBy("source").agg(F.count("*").alias(name))
    joined = base if sketched else base.join(distinct("http_path", "unique_paths"), "source", "left").join(distinct("user_agent", "unique_user_agents"), "source", "left")
    minutes = F.greatest((F.unix_micros("ends") - F.unix_micros("begins")) / 60_000_000, F.lit(0.01))
    total = F.col("total_requests")
    return joined.select(
        "source",
        total,
        F.coalesce("unique_paths", F.lit(0)).alias("unique_paths"),
        (F.col("errors") / total * 100).alias("error_rate_pct"),
        F.when(F.col("bytes_n") > 0, F.col("bytes_sum") / F.col("bytes_n")).otherwise(0.0).alias("avg_bytes"),
        F.coalesce("unique_user_agents", F.lit(0)).alias("unique_user_agents"),
        F.when(F.col("timed") >= 2, total / minutes).otherwise(0.0).alias("rpm"),
        "auth_failures",
        (F.col("off_hours") / total * 100).alias("off_hours_pct"),
        (F.col("posts") / total * 100).alias("post_ratio_pct"),
        "first_seq",
        "ts",
    )


def standardize_features(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Each column less its mean over its population deviation (a constant column is only shifted); NaN and infinity count as 0."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    clean = features.select("source", *(finite(F.col(c).cast("double")).alias(c) for c in columns))
    stats = clean.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    scaled = [((F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") > 0, F.col(f"{c}_std")).otherwise(1.0)).alias(c) for c in columns]
    return clean.crossJoin(F.broadcast(stats)).select("source", *scaled)
