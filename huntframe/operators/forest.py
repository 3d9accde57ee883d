"""A distributed isolation forest: trees grown in parallel on small samples, scores as expressions over their nodes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.config import DEFAULTS, HABITS
from huntframe.functions.scalars import map_of
from huntframe.operators.evidence import claim, fetch_evidence
from huntframe.operators.features import FEATURES, source_features, standardize_features
from huntframe.operators.statistical import finding, sentence
from huntframe.sources.scratch import kept

DETECTOR = "ML Detector (Isolation Forest)"
_EULER = 0.5772156649015329


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points, the usual yardstick for isolation depths."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + _EULER) - 2 * (n - 1) / safe, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, depth: int, limit: int, rng: np.random.Generator, nodes: list) -> int:
    """Append the nodes of a random tree: (feature, threshold, left, right, path length at a leaf)."""
    at = len(nodes)
    nodes.append(None)
    low, high = points.min(0), points.max(0)
    varying = np.flatnonzero(high > low)
    if depth >= limit or len(points) < 2 or not len(varying):
        nodes[at] = (-1, 0.0, -1, -1, depth + float(average_path(len(points))))
        return at
    feature = int(rng.choice(varying))
    threshold = float(rng.uniform(low[feature], high[feature]))
    left = points[:, feature] <= threshold
    nodes[at] = (feature, threshold, _grow(points[left], depth + 1, limit, rng, nodes), _grow(points[~left], depth + 1, limit, rng, nodes), 0.0)
    return at


NODES = "tree int, sample long, feature array<int>, threshold array<double>, below array<int>, above array<int>, path array<double>"


def fit_forest(features: DataFrame, columns: tuple[str, ...] = FEATURES, trees: int = DEFAULTS.forest_trees, sample: int = DEFAULTS.forest_sample, seed: int = 42) -> DataFrame:
    """One row of node arrays per tree. A tree's sample: the rows of lowest hash for it, drawn by threshold first, then cut to size."""
    n = features.count()
    share = min(1.0, 2.0 * sample / max(n, 1))
    # the trees that draw a source are picked before the source is repeated for them
    picked = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("source", t, F.lit(seed)).alias("draw"))), lambda x: F.pmod(x["draw"], F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    drawn = features.select("source", *columns, F.explode(picked).alias("x")).select("source", *columns, "x.*")

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "source"]).head(sample)
        tree = int(rows["tree"].iloc[0])
        nodes: list = []
        _grow(rows[list(columns)].to_numpy(float), 0, math.ceil(math.log2(max(2, len(rows)))), np.random.default_rng(seed * 100_003 + tree), nodes)
        feature, threshold, below, above, path = zip(*nodes)
        return pd.DataFrame({"tree": [tree], "sample": [len(rows)], "feature": [list(feature)], "threshold": [list(threshold)], "below": [list(below)], "above": [list(above)], "path": [list(path)]})

    return drawn.groupBy("tree").applyInPandas(grow, NODES)


def score_forest(features: DataFrame, forest: DataFrame, columns: tuple[str, ...] = FEATURES, sample: int = DEFAULTS.forest_sample) -> DataFrame:
    """(source, anomaly): minus two to the power of the mean isolation depth over its yardstick; lower is odder.

    Expressions of the JVM over the trees' node arrays, without a Python worker or a shuffle: the forest is a scalar subquery
    (trees * 2 * sample nodes at most, whatever the number of sources), and each tree is walked down level by level.
    """
    trees = forest.agg(F.array_sort(F.collect_list(F.struct("tree", "sample", *(F.col(c).cast("array<int>").alias(c) for c in ("feature", "below", "above")), "threshold", "path"))).alias("trees")).scalar()
    levels = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(max(2, sample)))))

    def depth(tree: Column, point: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            feature = F.get(tree["feature"], at)
            return F.when(feature < 0, at).when(F.get(point, feature) <= F.get(tree["threshold"], at), F.get(tree["below"], at)).otherwise(F.get(tree["above"], at))

        return F.get(tree["path"], F.aggregate(levels, F.lit(0), step))

    def anomaly(row: Column) -> Column:
        mean = F.aggregate(row["trees"], F.lit(0.0), lambda sum_, tree: sum_ + depth(tree, row["point"])) / F.greatest(F.size(row["trees"]), F.lit(1))
        return -F.pow(F.lit(2.0), -mean / F.greatest(_average_path(F.get(row["trees"], F.lit(0))["sample"]), F.lit(1e-9)))

    # a lambda's argument is worked out once a row; a column would be worked out anew at every step
    bound = features.select("source", F.array(F.struct(F.array(*(F.col(c).cast("double") for c in columns)).alias("point"), trees.alias("trees"))).alias("bound"))
    return bound.select("source", F.get(F.transform("bound", anomaly), F.lit(0)).alias("anomaly"))


def _average_path(n: Column) -> Column:
    """`average_path` of a column; 1 where there is none."""
    x = n.cast("double")
    return F.when(n > 2, 2 * (F.log(x - 1) + _EULER) - 2 * (x - 1) / x).when(n == 2, 1.0).when(n.isNull(), 1.0).otherwise(0.0)


def exact_quantile(values: DataFrame, column: str, share: float, room: int = 100_000, bins: int = 10_000) -> float | None:
    """The quantile between neighbours in rank, exactly, without a global sort; null and NaN are left out, None where nothing is left.

    One aggregate takes a mergeable sketch that tells `bins` ranks apart, whose answers should lie on both sides of the two
    ranks. A second pass counts what lies below and every distinct value between: the driver reads `room` of them at most. As
    counts decide, the sketch's error never shows. Two passes do unless more than `room` values lie between (some
    room * bins / 4 distinct values in all): then those alone are sketched again.
    """
    x = F.col("x")
    numbers = values.select(F.col(column).cast("double").alias("x")).filter(x.isNotNull() & ~F.isnan(x))
    margin = max(2 / bins, 2 / room)
    told = numbers.agg(F.count("*").alias("n"), F.percentile_approx("x", [max(0.0, share - margin), min(1.0, share + margin)], bins).alias("edges")).first()
    n = told["n"]
    if not n:
        return None
    place = share * (n - 1)
    first, second = math.floor(place), min(math.floor(place) + 1, n - 1)
    sure = (-math.inf, math.inf)  # both ranks lie between these, counted
    low, high = told["edges"] if n > room else sure
    while True:
        counted = numbers.filter(x <= high).groupBy(F.when(x >= low, x).alias("x")).agg(F.count("*").alias("n")).limit(room + 2).collect()
        if len(counted) <= room + 1:
            before = sum(r["n"] for r in counted if r["x"] is None)
            if before <= first and sum(r["n"] for r in counted) > second:
                break
        low, high, sure, bins = _narrowed(numbers, low, high, sure, first, second, bins)
    ranked = []
    for row in sorted((r for r in counted if r["x"] is not None), key=lambda r: r["x"]):
        ranked.append((before, before + row["n"], row["x"]))
        before += row["n"]
    below, above = (next(v for a, b, v in ranked if a <= k < b) for k in (first, second))
    return below if below == above else below + (above - below) * (place - first)


def _narrowed(numbers: DataFrame, low: float, high: float, sure: tuple[float, float], first: int, second: int, bins: int) -> tuple[float, float, tuple[float, float], int]:
    """Closer edges about the ranks (first, second), edges that are sure to hold them, and how fine to sketch."""
    x = F.col("x")
    below, up_to = numbers.agg(F.count_if(x < low), F.count_if(x <= high)).first()
    if below > first or up_to <= second:  # a rank lies outside: back to what is sure on that side
        return sure[0] if below > first else low, sure[1] if up_to <= second else high, sure, 2 * bins
    inside, fine = up_to - below, min(bins, 2**31 - 1)
    shares = [max(0.0, (first - below + 0.5) / inside - 2 / fine), min(1.0, (second - below + 0.5) / inside + 2 / fine)]
    edges = numbers.filter((x >= low) & (x <= high)).agg(F.percentile_approx("x", shares, fine).alias("edges")).first()["edges"]
    return *edges, (low, high), bins if tuple(edges) != (low, high) else 2 * bins


def _scores(features: DataFrame, trees: int, sample: int, least_sources: int, seed: int) -> DataFrame:
    scaled = standardize_features(features)
    enough = scaled.agg(F.count("*").alias("sources")).filter(F.col("sources") >= least_sources)
    return score_forest(scaled, fit_forest(scaled, trees=trees, sample=sample, seed=seed), sample=sample).join(F.broadcast(enough)).drop("sources")


def isolation_forest_scores(log: DataFrame, trees: int = DEFAULTS.forest_trees, sample: int = DEFAULTS.forest_sample, least_sources: int = DEFAULTS.forest_least_sources, seed: int = 42) -> DataFrame:
    """(source, anomaly) of every source; nothing where there are too few sources."""
    return _scores(kept(source_features(log)), trees, sample, least_sources, seed)


def ml_claims(log: DataFrame, contamination: float = DEFAULTS.contamination, trees: int = DEFAULTS.forest_trees, sample: int = DEFAULTS.forest_sample, least_sources: int = DEFAULTS.forest_least_sources, seed: int = 42) -> DataFrame:
    """ml_behavioural_anomaly without its lines. The features are worked out once and kept, and so are the scores."""
    features = kept(source_features(log))
    scores = kept(_scores(features, trees, sample, least_sources, seed))
    cut = exact_quantile(scores, "anomaly", contamination)
    limits = scores.agg(F.min("anomaly").alias("low"), F.max("anomaly").alias("high"))
    flagged = scores.filter(F.col("anomaly") < F.lit(cut)).crossJoin(F.broadcast(limits)).join(features, "source")
    place = F.when(F.col("high") > F.col("low"), (F.col("anomaly") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    score = F.greatest(F.lit(25), 100 - F.floor(place * 100).cast("int"))
    number = lambda c, text: F.col(c).cast("long" if "%d" in text else "double")
    habits = [F.when(F.col(c) > least, F.format_string(text, number(c, text))) for c, least, text in HABITS]
    parts = F.concat_ws(" ", sentence("ml_behavioural_anomaly", "source", score), *habits)
    found = flagged.withColumn("source_ip", F.nullif("source", F.lit("unknown"))).withColumn("username", F.lit(None).cast("string")).withColumn("count", F.col("total_requests"))
    return claim(finding(found, DETECTOR, 2, 1, "ml_behavioural_anomaly", score, parts, map_of(**{c: F.round(c, 2) for c in FEATURES})), "source")


def ml_behavioural_anomaly(log: DataFrame, contamination: float = DEFAULTS.contamination, **options) -> DataFrame:
    """Findings for the sources whose anomaly lies strictly below the contamination quantile."""
    return fetch_evidence(ml_claims(log, contamination, **options), log)
