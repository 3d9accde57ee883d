"""The forest's scores against a walk in plain Python, and quantiles against numpy."""

import math

import numpy as np
import pytest

from huntframe.operators.forest import average_path, exact_quantile, fit_forest, score_forest

COLUMNS = ("a", "b", "c")


def points(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"s{i}", *map(float, rng.normal(size=2)), float(rng.integers(0, 3))) for i in range(n)]
    return spark.createDataFrame(rows, "source string, a double, b double, c double").repartition(3)


def walked(features, forest):
    trees = forest.orderBy("tree").collect()
    found = {}
    for row in features.collect():
        depth = 0.0
        for t in trees:
            at = 0
            while t.feature[at] >= 0:
                at = t.below[at] if row[COLUMNS[t.feature[at]]] <= t.threshold[at] else t.above[at]
            depth += t.path[at]
        found[row.source] = -(2.0 ** (-depth / len(trees) / max(float(average_path(trees[0].sample)), 1e-9)))
    return found


@pytest.mark.parametrize("n, sample", [(300, 64), (40, 256), (2, 256), (1, 256)])
def test_scores_equal_a_plain_walk(spark, n, sample):
    features = points(spark, n)
    forest = fit_forest(features, COLUMNS, trees=12, sample=sample).persist()
    scores = {r.source: r.anomaly for r in score_forest(features, forest, COLUMNS, sample).collect()}
    expected = walked(features, forest)
    assert scores.keys() == expected.keys() and all(math.isclose(scores[s], expected[s], rel_tol=1e-12) for s in scores)


def test_scoring_needs_no_python_worker_and_no_shuffle_of_its_own(spark):
    features = points(spark, 50)
    forest = spark.createDataFrame(fit_forest(features, COLUMNS, trees=3).collect())
    plan = score_forest(features, forest, COLUMNS)._jdf.queryExecution().executedPlan()
    assert "MapInPandas" not in plan.toString() and "subquery" in plan.toString().lower()
    assert score_forest(features.limit(0), fit_forest(features.limit(0), COLUMNS, trees=3), COLUMNS).count() == 0


@pytest.mark.parametrize("room, bins", [(3, 8), (20, 100), (100, 10_000)])
def test_quantiles_of_ties_and_odd_numbers(spark, room, bins):
    rng = np.random.default_rng(7)
    for values in (np.repeat([1.0, 2.0], 400), np.r_[np.zeros(900), rng.normal(size=100)], rng.exponential(size=1500), np.r_[rng.normal(size=400), 1e300, -1e300]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").coalesce(2)
        for share in (0.05, 1.0):
            assert np.isclose(exact_quantile(df, "x", share, room=room, bins=bins), np.quantile(values, share), rtol=1e-12), (share, len(values))


def test_a_quantile_takes_two_passes(spark):
    df = spark.range(0, 300_000, numPartitions=4).selectExpr("cast(id * 7919 % 300007 AS double) AS x")
    tracker, jobs = spark.sparkContext.statusTracker(), []
    spark.sparkContext.setJobGroup("quantile", "")
    assert np.isclose(exact_quantile(df, "x", 0.05, room=2000, bins=10_000), np.quantile(df.toPandas()["x"], 0.05))
    jobs = tracker.getJobIdsForGroup("quantile")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 7  # two aggregates, each with a job or two of its own by adaptive execution, and the comparison's
