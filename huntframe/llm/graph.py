"""Connected components of a link table, as Spark jobs on the links alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.llm.common import cut, discard


def _star(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step on links (u, v) with u > v; no self links come out."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return small.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node it can reach.

    Rounds of large-star and small-star until nothing changes; each round's links are written to the
    shared folder, so a lost executor costs one round, and removed after the next. Repeated links and links to
    oneself do no harm; no links: no rows. Nodes without links are not listed.
    """
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    sign = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).alias("sign")
    seen = now.agg(sign).collect()[0]["sign"]
    while seen[0]:
        before, now = now, cut(_star(now))
        discard(before)
        was, seen = seen, now.agg(sign).collect()[0]["sign"]
        if was == seen:
            break
    found = cut(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    discard(now)
    return found
