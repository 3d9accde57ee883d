"""The filter of claimed addresses: none is missed, few others pass, and evidence is the same with and without it."""

from pyspark.sql import functions as F

from huntframe.operators.evidence import fetch_evidence, perhaps_among
from huntframe.operators.findings import union_claims
from huntframe.operators.statistical import path_claims, rate_claims
from huntframe.sources.scratch import kept
from tests.test_sketches import entries


def test_no_value_is_missed_and_few_others_pass(spark):
    rows = spark.range(0, 40_000).select(F.concat(F.lit("a"), "id").alias("claimed"), (F.col("id") % 40 == 0).alias("wanted"))
    wanted = kept(rows.filter("wanted").select("claimed"))
    for most_bits, others in ((1 << 26, 0.12), (64, 1.0)):
        passed = rows.filter(perhaps_among(wanted, "claimed", 1000, most_bits=most_bits)).groupBy("wanted").count().collect()
        passed = {r.wanted: r["count"] for r in passed}
        assert passed[True] == 1000 and passed.get(False, 0) <= others * 39_000
    assert rows.filter(perhaps_among(wanted.limit(0), "claimed", 0)).count() == 0


def test_evidence_is_the_same_behind_the_filter(spark):
    log = kept(entries(spark))
    claims = kept(union_claims(path_claims(log, 1.0), rate_claims(log, 100)))
    brief = lambda small: sorted((r.finding_type, r.source_ip, *r.evidence) for r in fetch_evidence(claims, log.withColumn("raw", F.concat_ws(" ", "source_ip", "http_path")), ("path_enumeration",), small=small).collect())
    assert brief(0) == brief(1 << 20) and {f[0] for f in brief(0)} == {"path_enumeration", "request_rate_spike"}
