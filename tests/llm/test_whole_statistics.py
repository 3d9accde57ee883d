"""Statistics and plans of the corpus operators are of all rows, whatever the number of keys."""

import math

from pyspark.sql import functions as F

from huntframe.llm import op5_source_mixing, op6_url_filters


def test_op6_every_suffix_has_its_own_rate(spark):
    n = 700  # domains; one in seven is only blocked, and one holds a third of the rows
    urls = [(f"http://a{c}.d{i}.org/s{i}/x", int(i % 7 == 0)) for i in range(n) for c in range(2)] + [("http://big.d1.org/s1/x", 0)] * n
    labels = spark.createDataFrame(urls, "url string, blocked int")
    host, path = op6_url_filters.host_and_path(F.col("url"))
    labelled = labels.select("url", host.alias("host"), path.alias("path"), "blocked")
    new = [("http://z.unseen.org/none/x", 0)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls + new)], "page_id long, url string")
    base = (n // 7 * 2 + 0.5) / (len(urls) + 1)
    found = []
    for few in (10, 50_000):  # joined in a shuffle, broadcast
        model = op6_url_filters.fit(labelled, trees=1, depth=1, few_rates=few)
        got = {r.page_id: (r.suffix2, r.segment) for r in model.with_features(pages.select("page_id", "url", host.alias("host"), path.alias("path"))).collect()}
        assert len(got) == len(urls) + 1
        for i in range(n):
            count = 2 + n * (i == 1)
            want = (2 * (i % 7 == 0) + 10 * base) / (count + 10)
            assert all(math.isclose(x, want) for x in got[2 * i]), i
        assert all(math.isclose(x, base) for x in got[len(urls)])
        found.append(got)
    assert found[0] == found[1]


def test_op6_sample_has_its_share_of_a_repeated_url(spark):
    labels = spark.createDataFrame([("http://same.org/", i % 2) for i in range(4000)] + [(f"http://h{i}.org/", i % 2) for i in range(4000)], "url string, blocked int")
    host, path = op6_url_filters.host_and_path(F.col("url"))
    drawn = op6_url_filters.sampled(labels.select("url", host.alias("host"), path.alias("path"), "blocked"), 0.1)
    sizes = {r.same: r.n for r in drawn.groupBy((F.col("url") == "http://same.org/").alias("same")).agg(F.count("*").alias("n")).collect()}
    assert 398 <= sizes[True] <= 402 and 340 <= sizes[False] <= 460


def test_op5_a_rest_that_rounds_up_is_a_whole_epoch(spark):
    # Weights 332 and 168 share 150 words as 99.6 and 50.4: just under two epochs of a (50 words), half of b (100 words).
    docs = spark.createDataFrame([(i, "a" if i < 5 else "b", " ".join(["w"] * 10)) for i in range(15)], "doc_id long, source string, text string")
    mixed = op5_source_mixing.mix(docs, weights=(332, 168)).collect()
    assert [r.taken for r in mixed if r.doc_id < 5] == [20] * 5
    assert sum(r.taken for r in mixed if r.doc_id >= 5) == 50
    copies = op5_source_mixing.apply_mix(docs, weights=(332, 168)).groupBy("source").agg(F.count("*").alias("n")).collect()
    assert {r.source: r.n for r in copies} == {"a": 10, "b": 5}
    # 49.6 of 50 words: one epoch, not none.
    mixed = op5_source_mixing.mix(docs, weights=(496, 1004)).collect()
    assert [r.taken for r in mixed if r.doc_id < 5] == [10] * 5
