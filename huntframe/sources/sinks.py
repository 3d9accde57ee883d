"""Where findings and runs go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _replace(rows: DataFrame, path: str, run_id: str, run_date: str, kind: str) -> None:
    """Put the rows of a run in the place of those that an earlier try of it wrote; other runs are left alone."""
    named = rows.withColumn("run_id", F.lit(run_id)).withColumn("run_date", F.lit(run_date))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "run_id").format(kind).save(path)


def write_findings(findings: DataFrame, path: str, run_id: str, run_date: str, kind: str = "parquet") -> None:
    """Findings of a run, partitioned by date and run, as Parquet or JSON. Writing a run again replaces it, so that one tried twice is there once; a run without findings leaves none."""
    if findings.isEmpty():
        jvm, conf = findings.sparkSession._jvm, findings.sparkSession._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/run_date={_escaped(run_date)}/run_id={_escaped(run_id)}")
        place.getFileSystem(conf).delete(place, True)
    _replace(findings, path, run_id, run_date, kind)


def _escaped(name: str) -> str:
    """A value as Spark writes it in a partition's folder."""
    return "".join(c if c not in "\"#%'*/:=?\\\x7f{}[]^" and ord(c) >= 32 else f"%{ord(c):02X}" for c in name)


def write_run(stats: DataFrame, findings: DataFrame, path: str, run_id: str, detectors: tuple[str, ...], run_date: str, seconds: float | None = None) -> None:
    """A run's record: line counts, number of findings, the detectors used, how long it took and when it was written. Writing it again replaces it."""
    record = stats.crossJoin(findings.agg(F.count("*").alias("findings"))).withColumn("detectors", F.array(*map(F.lit, detectors)).cast("array<string>"))
    timed = record.withColumn("analysis_duration_seconds", F.round(F.lit(seconds).cast("double"), 3)).withColumn("analysed_at", F.current_timestamp())
    _replace(timed, path, run_id, run_date, "parquet")


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, run_date, log_format, total_lines, parsed_lines, parse_errors, findings, detectors, analysis_duration_seconds, analysed_at) of every run written to path."""
    text = lambda c: F.col(c).cast("string").alias(c)
    return spark.read.parquet(path).select(text("run_id"), text("run_date"), "log_format", "total_lines", "parsed_lines", "parse_errors", "findings", "detectors", "analysis_duration_seconds", "analysed_at")
