"""Distinct counts by sketches: the same findings as by counts, and features within the sketch's error."""

from pyspark.sql import functions as F

from huntframe.operators.features import source_features
from huntframe.operators.statistical import path_enumeration
from huntframe.schema import LOG_ENTRY


def entries(spark):
    """60 addresses of 5 to 9 paths, four of 100, 200, 2,000 and 4,000 paths, each asked for twice, and rows without an address or a path."""
    sizes = [(f"10.0.0.{i}", 5 + i % 5) for i in range(60)] + [("9.0.0.1", 100), ("9.0.0.2", 200), ("9.0.0.3", 2000), ("9.0.0.4", 4000)]
    asked = spark.createDataFrame(sizes, "source_ip string, n int").select("source_ip", F.explode(F.sequence(F.lit(1), F.col("n") * 2)).alias("k"), "n")
    asked = asked.select("source_ip", F.concat(F.lit("/p/"), F.col("k") % F.col("n")).alias("http_path"), F.concat(F.lit("ua"), F.col("k") % 3).alias("user_agent"))
    odd = spark.createDataFrame([(None, "/x", "u"), ("", "/y", ""), ("10.0.0.1", None, None), ("10.0.0.2", "", "")], asked.schema)
    rows = asked.unionByName(odd).withColumn("seq", F.monotonically_increasing_id()).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") % 1000))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in LOG_ENTRY if f.name not in (*rows.columns, "ts_local")]
    return rows.select("*", *missing).withColumn("ts_local", F.col("ts").cast("timestamp_ntz")).repartition(6)


def test_findings_and_features_by_sketches(spark):
    log = entries(spark)
    brief = lambda found: sorted((r.source_ip, r["count"], len(r.evidence)) for r in found.collect())
    for zscore in (1.0, 3.0):
        exact = brief(path_enumeration(log, zscore=zscore))
        assert exact and exact == brief(path_enumeration(log, zscore=zscore, sketched=True))
    exact, about = ({r.source: r.asDict() for r in source_features(log, sketched=s).collect()} for s in (False, True))
    assert exact.keys() == about.keys()
    for source, row in exact.items():
        few = row["unique_paths"] <= 1500
        assert abs(about[source]["unique_paths"] - row["unique_paths"]) <= (0 if few else 0.03 * row["unique_paths"]), source
        assert about[source]["unique_user_agents"] == row["unique_user_agents"] and about[source]["total_requests"] == row["total_requests"]


def test_sketches_of_nothing(spark):
    log = entries(spark).limit(0)
    assert path_enumeration(log, sketched=True).count() == 0 and source_features(log, sketched=True).count() == 0
