"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A source's target is its weight's share of the total, but at most max_epochs times what it holds; the
excess of capped sources goes to the others by weight until none is above its cap. With the sources in
the order of cap over weight, the capped ones are a prefix, so the fixed point of that redistribution is
read off running sums: one small row per source, no loop.

A document is taken whole as often as its source's target holds the source; the rest of the target is
filled by the documents first in a seeded order (md5 of seed and doc_id), the last of them in part, so
each source's words meet its target to the word. Where that order ends in a source is found from sums
over draw buckets and then inside the one bucket it falls in: no source is sorted or gathered whole.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, sorted last; a
source without words has target 0. Rows with the same doc_id share their draw, and split a partial take
by size. No rows: no rows. Extra columns are ignored (mix) or kept (apply_mix).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.llm.common import cut, table

NAME = "op5_source_mixing"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def word_count(text: str = "text") -> F.Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: int) -> F.Column:
    """A document's place in the seeded order, as hex text."""
    return F.md5(F.concat(F.lit(f"{seed}:" if seed else ""), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Water-filling over (source, source_size): adds weight and target (double). One row per source goes through one task."""
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    weighed = totals.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    room = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(filling), F.lit(0))).cast("double")
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filling), F.lit(0))
    level = weighed.withColumn("level", room / rest)  # a word per unit of weight, were all before this one capped
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("level").alias("level")))).over(every)
    return level.withColumn("level", fits["level"]).select("source", "source_size", "weight", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, digits: int = 3) -> DataFrame:
    """Per source: target, whole repetitions, and where in the seeded order the fractional one ends.

    sized has source, doc_id, size and draw. last_draw is the draw of the document that is taken in part:
    part of last_size words. Draws below it are taken once more.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(totals, weights, max_epochs)
    whole = F.least(F.lit(max_epochs), F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
    wanted = wanted.withColumn("whole", whole.cast("long")).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    full = (F.col("source_size") > 0) & (F.col("rest") >= F.col("source_size"))  # a rest that rounds up to the whole source is one more repetition
    wanted = wanted.withColumn("whole", F.when(full, F.col("whole") + 1).otherwise(F.col("whole"))).withColumn("rest", F.when(full, 0).otherwise(F.col("rest")).cast("long"))
    bucket = F.substring("draw", 1, digits)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(ahead), F.lit(0)))
    same = F.col("s.source").eqNullSafe(F.col("w.source"))
    last = buckets.alias("s").join(wanted.alias("w"), same).filter("before <= rest AND rest < before + held").select("s.source", "bucket", "before", "rest")
    inside = sized.withColumn("bucket", bucket).groupBy("source", "bucket", "draw").agg(F.sum("size").alias("last_size")).filter("last_size > 0")
    within = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        inside.alias("s")
        .join(last.alias("w"), same & (F.col("s.bucket") == F.col("w.bucket")))
        .select("s.source", "draw", "last_size", "before", "rest")
        .withColumn("part", F.col("rest") - F.col("before") - F.coalesce(F.sum("last_size").over(within), F.lit(0)))
        .filter("part >= 0 AND part < last_size")
        .select("source", F.col("draw").alias("last_draw"), "last_size", "part")
    )
    return wanted.alias("w").join(last.alias("s"), same, "left").select("w.source", "source_size", "target", "whole", "last_draw", "last_size", "part")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """Every document with its size, source size and target, and the words that the mix takes of it."""
    sized = cut(docs.select("doc_id", "source", word_count().alias("size"), draw(seed).alias("draw")))
    same = F.col("d.source").eqNullSafe(F.col("p.source"))
    more = F.when(F.col("draw") < F.coalesce("last_draw", F.lit("g")), F.col("size")).when(F.col("draw") == F.col("last_draw"), F.floor(F.col("part") * F.col("size") / F.col("last_size"))).otherwise(0)
    more = F.when(F.col("last_draw").isNull(), 0).otherwise(more)
    side = plan(sized, weights, max_epochs)
    joined = sized.alias("d").join((F.broadcast(side) if _few_sources(sized) else side).alias("p"), same)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """The mixed corpus: each document's row as often as the mix takes it whole (the one taken in part counts from a half)."""
    sized = cut(docs.select("doc_id", "source", word_count().alias("size"), draw(seed).alias("draw")))
    planned = plan(sized, weights, max_epochs)
    side = planned.select("source", "whole", "last_draw", "last_size", "part")
    side = F.broadcast(side) if _few_sources(sized) else side
    marked = docs.select(F.struct(*docs.columns).alias("doc"), draw(seed).alias("draw"), "source")  # whatever the columns are called
    joined = marked.alias("d").join(side.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    more = F.when((F.col("draw") < F.col("last_draw")) | ((F.col("draw") == F.col("last_draw")) & (2 * F.col("part") >= F.col("last_size"))), 1).otherwise(0)
    return joined.select("doc", F.explode(F.array_repeat(F.lit(0), (F.col("whole") + more).cast("int")))).select("doc.*")


def _few_sources(sized: DataFrame, most: int = 50_000) -> bool:
    """Whether the plan, one short row per source, is proven small enough to broadcast."""
    return sized.select("source").distinct().limit(most + 1).count() <= most


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source, weights 1, 2, 3 repeating, at most three epochs."""
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS draw FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM totals
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level, row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS k
  FROM weighed WINDOW f AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), wanted AS (
  SELECT source, source_size, least((SELECT arg_min(level, k) FROM levels WHERE level * weight <= cap) * weight, cap::DOUBLE) AS target FROM levels
), rest AS (
  SELECT *, least(3, floor(target / greatest(source_size, 1)))::BIGINT AS whole, floor(target - least(3, floor(target / greatest(source_size, 1)))::BIGINT * source_size + 0.5)::BIGINT AS more FROM wanted
), runs AS (
  SELECT s.*, r.source_size, r.target, r.whole, r.more, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN rest r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, more - before)))::BIGINT AS taken FROM runs
"""
