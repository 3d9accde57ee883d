"""Evidence: the first lines of each flagged group, fetched after the groups are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.operators.keyed import LINES, WIDTH, first_lines
from huntframe.sources.scratch import once, written_bytes


def evidence_top(rows: DataFrame, keys: list[str], order: list[str], most: int = LINES, width: int = WIDTH) -> DataFrame:
    """keys and `evidence`: the first lines of each group in order, each cut to width."""
    return first_lines(rows.select(*keys, *order, F.substring("raw", 1, width).alias("line")), keys, order, most)


def with_evidence(findings: DataFrame, rows: DataFrame, keys: list[str], order: list[str], most: int = LINES) -> DataFrame:
    """findings with the evidence of their groups; only rows of flagged groups are ranked."""
    flagged = rows.join(findings.select(*keys).distinct(), keys, "left_semi")
    return findings.join(evidence_top(flagged, keys, order, most), keys, "left")


def claim(found: DataFrame, key: str = "source_ip") -> DataFrame:
    """found with what `fetch_evidence` needs: the address whose lines are wanted, and from where on (nowhere: all of them)."""
    begin = F.col("begin") if "begin" in found.columns else F.lit(None).cast("struct<ts:timestamp,seq:bigint>")
    return found.withColumn("claimed", F.col(key)).withColumn("begin", begin)


def perhaps_among(values: DataFrame, key: str, n: int, bits_each: int = 16, most_bits: int = 1 << 26) -> Column:
    """True for a row whose key is one of the n rows of values, and for few others: a bit for each hash, at most 8 MB for all of them.

    The bits are a scalar subquery, so tasks test rows before anything is shuffled. Beyond most_bits / bits_each values more
    of the others pass; none of the values is ever missed.
    """
    cells = max(64, min(most_bits, 1 << (bits_each * max(n, 1) - 1).bit_length()))
    cell = F.pmod(F.xxhash64(key), F.lit(cells))
    word, bit = (cell / 64).cast("int"), (cell % 64).cast("int")
    words = values.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    every = values.sparkSession.range(cells // 64).join(words, F.col("id") == F.col("word"), "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("x"))
    bits = every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("bits")).scalar()
    return F.getbit(F.get(bits, word), bit) == 1


def fetch_evidence(findings: DataFrame, log: DataFrame, with_paths: tuple[str, ...] = (), by_time: tuple[str, ...] = (), small: int = 8 << 20) -> DataFrame:
    """Evidence of findings about addresses (see `claim`), of all types in one pass over the log.

    The findings are written first. So Spark knows their size and broadcasts the claims where they are small enough: then no
    line is shuffled but the first ones of claimed addresses, task by task. Where the written
    claims take more than `small` bytes, which may be beyond that limit, a filter of bits comes first: lines of addresses that nobody claims hardly ever reach the shuffle of the join.
    with_paths: types that show requests with a path only; by_time: types whose lines stand in order of time, from `begin` on.
    """
    findings = once(findings)
    rows = log.select(F.coalesce(F.nullif("source_ip", F.lit("")), F.lit("unknown")).alias("claimed"), (F.coalesce("http_path", F.lit("")) != "").alias("with_path"), "ts", "seq", F.substring("raw", 1, WIDTH).alias("line"))
    wanted = findings.select("finding_type", "claimed", "begin")
    if written_bytes(findings) > small:
        rows = rows.filter(perhaps_among(wanted, "claimed", wanted.count()))
    timed = F.col("finding_type").isin(*by_time) if by_time else F.lit(False)
    pathed = F.col("finding_type").isin(*with_paths) if with_paths else F.lit(False)
    inside = rows.join(wanted, "claimed").filter((~pathed | F.col("with_path")) & (~timed | (F.struct("ts", "seq") >= F.col("begin"))))
    lines = first_lines(inside.withColumn("turn", F.when(timed, F.col("ts"))), ["finding_type", "claimed"], ["turn", "seq"])
    return findings.join(lines, ["finding_type", "claimed"], "left").drop("claimed", "begin")
