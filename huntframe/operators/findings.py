"""What happens to findings: union, merging, correlation, ranking and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huntframe import config
from huntframe.functions.scalars import severity_of
from huntframe.schema import FINDING, conform

#: The order in which findings are merged: by detector, then rule, then the group's first row, then the row.
ARRIVAL_ORDER = ("detector_rank", "arrival")


def union_findings(*found: DataFrame) -> DataFrame:
    """The findings of the enabled detectors, as one table."""
    return reduce(DataFrame.unionByName, (conform(f, FINDING) for f in found))


def union_claims(*claims: DataFrame) -> DataFrame:
    """Findings whose lines are still to be fetched, as one table."""
    columns = [c for c in FINDING.fieldNames() if c != "evidence"]
    return reduce(DataFrame.unionByName, (c.select(*columns, "claimed", "begin") for c in claims))


def dedup_findings(findings: DataFrame, most_evidence: int = 10) -> DataFrame:
    """One finding per (type, address, user).

    Folding in order of arrival, a strictly higher score takes over and puts its lines in front; others
    append theirs. In closed form: the lines of the running maxima, last first, then the lines of the
    others in order; the winner is the first of the highest score; the count is the highest from there on.

    Only the first finding of each score can be a running maximum, so a key has 101 candidates at most however
    many findings it has; lines are ranked by (key, line) with a group limit. No key's findings meet in one task.
    findings is read three times: keep it first if it is dear to work out.
    """
    key = ["finding_type", "merge_ip", "merge_user"]
    place = F.struct(*ARRIVAL_ORDER)
    keyed = findings.withColumn("merge_ip", F.coalesce("source_ip", F.lit(""))).withColumn("merge_user", F.coalesce("username", F.lit("")))
    shown = [c for c in FINDING.fieldNames() if c not in ("finding_type", "severity_score")]
    firsts = keyed.groupBy(*key, "severity_score").agg(F.min_by(F.struct(*shown), place).alias("f"))
    order = Window.partitionBy(*key).orderBy(F.struct("f.detector_rank", "f.arrival"))
    earlier = F.max("severity_score").over(order.rowsBetween(Window.unboundedPreceding, -1))
    records = firsts.withColumns({"turn": F.row_number().over(order), "earlier": earlier}).filter("earlier IS NULL OR severity_score > earlier").drop("earlier")
    # the last of the running maxima is the first of the highest score
    winner = records.withColumn("last", F.max("turn").over(Window.partitionBy(*key))).filter("turn = last").select(*key, "severity_score", "f.*")
    since = winner.select(*key, F.struct(*ARRIVAL_ORDER).alias("won"))
    totals = keyed.select(*key, F.col("count").alias("n"), place.alias("at")).join(since, key).filter("at >= won").groupBy(*key).agg(F.max("n").alias("merged_count"))
    # every line in order of arrival, and those of the running maxima once more in front; the first place of a line counts
    nowhere = F.lit(None).cast(FINDING["arrival"].dataType)
    behind = keyed.select(*key, F.posexplode("evidence").alias("at", "line"), F.struct(F.lit(0).alias("back"), "detector_rank", "arrival").alias("turn"))
    front = records.select(*key, F.posexplode("f.evidence").alias("at", "line"), F.struct((-F.col("turn")).alias("back"), F.lit(None).cast("int").alias("detector_rank"), nowhere.alias("arrival")).alias("turn"))
    distinct = behind.unionByName(front).groupBy(*key, "line").agg(F.min(F.struct("turn", "at")).alias("turn"))
    ranked = distinct.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("turn"))).filter(F.col("n") <= most_evidence)
    evidence = ranked.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("merged_evidence"))
    merged = winner.join(totals, key).join(evidence, key, "left")
    return conform(merged.withColumn("count", F.col("merged_count")).withColumn("evidence", F.coalesce("merged_evidence", F.array().cast("array<string>"))), FINDING)


def correlate_findings(findings: DataFrame) -> DataFrame:
    """Raise findings whose address several detectors flagged: 10, 20 or 30 for 2, 3 or more of them."""
    counts = findings.filter("source_ip <> ''").groupBy("source_ip").agg(F.countDistinct("detector").alias("detectors"))
    joined = findings.join(counts, "source_ip", "left")
    boost = F.when(F.col("detectors") >= 4, 30).when(F.col("detectors") == 3, 20).when(F.col("detectors") == 2, 10).otherwise(0)
    suffix = F.when(boost > 0, F.format_string(config.SENTENCES["corroborated"], "detectors")).otherwise("")
    raised = joined.withColumn("description", F.concat("description", suffix)).withColumn("severity_score", F.least(F.lit(100), F.col("severity_score") + boost))
    return raised.withColumn("severity", F.when(boost > 0, severity_of(F.col("severity_score"))).otherwise(F.col("severity")))


def rank_findings(findings: DataFrame) -> DataFrame:
    """Highest score first, then in order of arrival: a global sort, for the sink only."""
    return findings.orderBy(F.desc("severity_score"), *ARRIVAL_ORDER, "finding_type", "source_ip", "username")


def process_findings(findings: DataFrame) -> DataFrame:
    """Merged, correlated and ranked."""
    return rank_findings(correlate_findings(dedup_findings(findings)))


def severity_summary(findings: DataFrame) -> DataFrame:
    """(severity, findings) with a row for each severity, also those without findings."""
    every = findings.sparkSession.createDataFrame([(s,) for s in config.RISK_WEIGHTS], "severity string")
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("findings"))


def severity_share(findings: DataFrame) -> DataFrame:
    """(severity, findings, pct): whole percent of all findings."""
    summary = severity_summary(findings)
    total = summary.agg(F.sum("findings").alias("total"))
    pct = F.when(F.col("total") > 0, F.floor(F.col("findings") * 100 / F.col("total"))).otherwise(0)
    return summary.crossJoin(F.broadcast(total)).select("severity", "findings", pct.cast("int").alias("pct"))


def overall_risk(findings: DataFrame) -> DataFrame:
    """(risk, label): mean of the scores weighted by severity, and its name; 0 without findings."""
    weight = F.element_at(F.create_map(*(F.lit(x) for s, w in config.RISK_WEIGHTS.items() for x in (s, int(100 * w)))), F.col("severity"))
    summed = findings.agg(F.sum(weight * F.col("severity_score")).alias("s"), F.count("*").alias("n"))
    risk = F.when(F.col("n") > 0, F.least(F.lit(100), F.floor(F.col("s") / (100 * F.col("n"))))).otherwise(0).cast("int")
    *upper, (last, _) = config.RISK_LABELS
    label = F.lit(last)
    for name, least in reversed(upper):
        label = F.when(F.col("risk") >= least, name).otherwise(label)
    return summed.select(risk.alias("risk")).withColumn("label", label)


def top_source_ips(findings: DataFrame, n: int = 10) -> DataFrame:
    """The n addresses of highest score: findings, highest score and the types, ties by address."""
    grouped = findings.filter("source_ip <> ''").groupBy("source_ip").agg(F.count("*").alias("finding_count"), F.max("severity_score").alias("max_score"), F.sort_array(F.collect_set("finding_type")).alias("finding_types"))
    return grouped.orderBy(F.desc("max_score"), "source_ip").limit(n)
