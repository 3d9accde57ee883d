"""Findings that only show in when things happen. Order within a source is by instant, then by input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe import config
from huntframe.config import DEFAULTS, SENTENCES
from huntframe.functions.scalars import ADDRESS_FIRST, USER_FIRST, is_auth_failure, is_off_hours, is_process, is_weekend_sensitive, map_of
from huntframe.operators.evidence import claim, fetch_evidence
from huntframe.operators.keyed import WIDTH, KeyedRule, keyed_findings, quoted
from huntframe.operators.statistical import finding, sentence
from huntframe.operators.tags import TECHNIQUES

DETECTOR = "Temporal Detector"
#: Seconds of a stretch of time that one task sees of one source.
STRETCH = 3600
#: Rows of one source in one stretch beyond which it is cut once more.
MOST_ROWS = 500_000


def _rule(name: str, rule_rank: int, meets: Column, key: str, enough: str, score: str, parts: str, extra: str = "NULL") -> KeyedRule:
    return KeyedRule(name, F.col("ts").isNotNull() & meets, key, enough, score, f"format_string({quoted(SENTENCES[name])}, {parts})", (TECHNIQUES[name],), DETECTOR, 3, rule_rank, extra, by_time=True)


def off_hours_rule(day_begins: int = DEFAULTS.day_begins, day_ends: int = DEFAULTS.day_ends, least: int = DEFAULTS.off_hours_events) -> KeyedRule:
    """Authentication and sensitive events outside business hours, by source."""
    touchy = is_process(config.AUTH_PROCESSES_TEMPORAL) | is_process(config.SENSITIVE_PROCESSES) | F.coalesce(F.col("event_id").isin(*config.OFF_HOURS_EVENTS), F.lit(False))
    return _rule("off_hours_auth_activity", 1, is_off_hours(day_begins, day_ends) & touchy, ADDRESS_FIRST, f"count >= {least}", "45 + 2 * count", f"count, {day_begins}, {day_ends}, key")


def weekend_rule() -> KeyedRule:
    """Account, service and audit changes on a weekend, by user first."""
    return _rule("weekend_sensitive_activity", 4, is_weekend_sensitive(), USER_FIRST, "true", "35 + 3 * count", "count, key")


def slow_rule(failures: int = DEFAULTS.slow_failures, minutes: int = DEFAULTS.slow_minutes) -> KeyedRule:
    """Sources whose failures are many but spread over at least `minutes`."""
    lasted = "(unix_micros(ends) - unix_micros(begins))"
    whole = f"({lasted} div 60000000)"  # minutes
    duration = f"concat(if({whole} >= 60, concat({whole} div 60, 'h '), ''), {whole} % 60, 'm')"
    meets = is_auth_failure(config.FAILURE_WORDS_TEMPORAL, config.AUTH_PROCESSES_TEMPORAL)
    return _rule("slow_brute_force", 5, meets, ADDRESS_FIRST, f"count >= {failures} AND {lasted} >= {minutes} * 60000000", "50 + count", f"count, key, {duration}", f"map('duration_minutes', cast({whole} AS string))")


def off_hours_auth_activity(log: DataFrame, day_begins: int = DEFAULTS.day_begins, day_ends: int = DEFAULTS.day_ends, least: int = DEFAULTS.off_hours_events) -> DataFrame:
    """Authentication and sensitive events outside business hours, by source."""
    return keyed_findings(log, [off_hours_rule(day_begins, day_ends, least)])


def weekend_sensitive_activity(log: DataFrame) -> DataFrame:
    """Account, service and audit changes on a weekend, by user first."""
    return keyed_findings(log, [weekend_rule()])


def slow_brute_force(log: DataFrame, failures: int = DEFAULTS.slow_failures, minutes: int = DEFAULTS.slow_minutes) -> DataFrame:
    """Sources whose failures are many but spread over at least `minutes`."""
    return keyed_findings(log, [slow_rule(failures, minutes)])


def _parts(timed: DataFrame, crowded: DataFrame, key: str, seconds: int, back: int, most: int) -> DataFrame:
    """(key, chunk, parts): where parts of about `most` rows begin in a crowded stretch, and from which second on rows are copied into them.

    Counts by second tell how far back a part must see: `back` rows, or `seconds` where those hold fewer. One row a
    crowded stretch, and one part for each `most` rows of the whole table at most, and for each second of it.
    """
    by_second = timed.join(F.broadcast(crowded), [key, "chunk"], "left_semi").groupBy(key, "chunk", "second").agg(F.count("*").alias("n"))
    order = Window.partitionBy(key, "chunk").orderBy("second")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = by_second.withColumn("before", before).withColumn("part", F.floor(F.col("before") / most))
    begin = counted.groupBy(key, "chunk", "part").agg(F.min("second").alias("begin"), F.min("before").alias("before"))
    # the last second from which on there are rows enough before the part begins
    seconds_of = counted.groupBy(key, "chunk").agg(F.collect_list(F.struct("second", "before")).alias("held"))  # no more than the stretch has seconds
    far = F.array_max(F.transform(F.filter("held", lambda h: h["before"] <= F.col("before") - back), lambda h: h["second"]))
    parts = begin.join(seconds_of, [key, "chunk"]).withColumn("copied", F.greatest(F.col("begin") - seconds, F.coalesce(far, F.col("begin") - seconds)))
    return parts.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("begin", "copied"))).alias("parts"))


def in_stretches(rows: DataFrame, key: str, seconds: int, back: int, stretch: int = STRETCH, most: int = MOST_ROWS) -> tuple[DataFrame, Window]:
    """rows with us, chunk, part and copy, and the window (key, chunk, part) in order of time: what looks back `back` rows, and `seconds` at most, sees all it needs there.

    A source is cut into stretches of time, so no task sorts all rows of one that holds most of them. The rows
    of the last `seconds` of a stretch are copied into the next one, where they are looked back at (copy is
    true) but stand for nothing themselves. Exact, since a stretch is no shorter than `seconds`. A stretch of more
    than `most` rows is cut once more, by seconds, into parts of about so many; only what is looked back at is copied
    from one part to the next. Rows of one second are not parted. A count by stretch, made at once, tells whether there are any.
    """
    size, span, most = max(stretch, seconds) * 1_000_000, seconds * 1_000_000, max(most, back)
    us, chunk, second = F.col("us"), F.col("chunk"), F.col("second")
    timed = rows.withColumn("us", F.unix_micros("ts")).withColumn("chunk", F.floor((us - F.pmod(us, F.lit(size))) / size))
    crowded = timed.groupBy(key, "chunk").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(key, "chunk")
    place = lambda c, p, copy: F.struct(c.alias("chunk"), p.cast("int").alias("part"), F.lit(copy).alias("copy"))
    window = Window.partitionBy(key, "chunk", "part").orderBy("us", "seq")
    late = F.pmod(us, F.lit(size)) >= size - span
    into_next = place(chunk + 1, F.lit(1), True)
    if crowded.isEmpty():
        own = place(chunk, F.lit(1), False)
        dealt = timed.withColumn("place", F.explode(F.when(late, F.array(own, into_next)).otherwise(F.array(own))))
        return dealt.select(*rows.columns, "us", "place.*"), window
    timed = timed.withColumn("second", F.floor((us - F.pmod(us, F.lit(1_000_000))) / 1_000_000))
    parts = _parts(timed.select(key, "chunk", "second"), crowded, key, seconds, back, most)
    parted = timed.join(F.broadcast(parts), [key, "chunk"], "left")
    begun = F.size(F.filter("parts", lambda p: p["begin"] <= second))
    own = F.array(place(chunk, F.when(F.col("parts").isNull(), 1).otherwise(begun), False))
    counted = F.transform("parts", lambda p, i: F.struct(p["begin"].alias("begin"), p["copied"].alias("copied"), (i + 1).alias("part")))
    seen = F.transform(F.filter(counted, lambda p: (p["copied"] <= second) & (second < p["begin"]) & (p["part"] > 1)), lambda p: place(chunk, p["part"], True))
    none = F.array().cast("array<struct<chunk:bigint,part:int,copy:boolean>>")
    dealt = parted.withColumn("place", F.explode(F.concat(own, F.when(late, F.array(into_next)).otherwise(none), F.coalesce(seen, none))))
    return dealt.select(*rows.columns, "us", "place.*"), window


def bursts(log: DataFrame, events: int = DEFAULTS.burst_events, seconds: int = DEFAULTS.burst_seconds, stretch: int = STRETCH, most: int = MOST_ROWS) -> DataFrame:
    """(source_ip, begin): where the first `events` requests of an address within `seconds` begin, as (ts, seq). A row ends such a run if the row events-1 before it is near enough."""
    dealt, back = in_stretches(log.filter("source_ip <> '' AND ts IS NOT NULL").select("source_ip", "ts", "seq"), "source_ip", seconds, events - 1, stretch, most)
    begun = F.lag(F.struct("us", "ts", "seq"), events - 1).over(back) if events > 1 else F.struct("us", "ts", "seq")
    hits = dealt.withColumn("begin", begun).filter(~F.col("copy") & (F.col("us") - F.col("begin.us") <= seconds * 1_000_000))
    return hits.groupBy("source_ip").agg(F.min_by(F.struct("begin.ts", "begin.seq"), F.struct("us", "seq")).alias("begin"))


def burst_claims(log: DataFrame, events: int = DEFAULTS.burst_events, seconds: int = DEFAULTS.burst_seconds, stretch: int = STRETCH) -> DataFrame:
    """request_burst without its lines."""
    found = bursts(log, events, seconds, stretch).select("source_ip", F.lit(None).cast("string").alias("username"), F.col("begin.ts").alias("ts"), F.col("begin.seq").alias("first_seq"), F.lit(events).cast("long").alias("count"), "begin")
    text = sentence("request_burst", "source_ip", "count", F.lit(seconds))
    return claim(finding(found, DETECTOR, 3, 2, "request_burst", 50 + F.col("count"), text, map_of(window_seconds=F.lit(seconds))))


def request_burst(log: DataFrame, events: int = DEFAULTS.burst_events, seconds: int = DEFAULTS.burst_seconds, stretch: int = STRETCH) -> DataFrame:
    """The first time that an address sends `events` requests within `seconds`."""
    return fetch_evidence(burst_claims(log, events, seconds, stretch), log, by_time=("request_burst",))


def impossible_travel(log: DataFrame, seconds: int = DEFAULTS.travel_seconds, stretch: int = STRETCH, most: int = MOST_ROWS) -> DataFrame:
    """Consecutive events of one user from different addresses, not more than `seconds` apart."""
    rows = log.filter("username <> '' AND source_ip <> '' AND ts IS NOT NULL").select("username", "source_ip", "ts", "seq", F.substring("raw", 1, WIDTH).alias("line"))
    dealt, back = in_stretches(rows, "username", seconds, 1, stretch, most)
    before = F.lag(F.struct("source_ip", "us", "line")).over(back)
    micros = F.col("us") - F.col("before.us")
    moved = dealt.withColumn("before", before).filter(~F.col("copy") & (F.col("before.source_ip") != F.col("source_ip")) & (micros <= seconds * 1_000_000))
    gap = F.floor(micros / 1_000_000).cast("int")
    found = moved.select("username", "source_ip", "ts", F.col("seq").alias("first_seq"), F.lit(2).cast("long").alias("count"), F.col("before.source_ip").alias("ip_a"), gap.alias("delta_seconds"), F.array("before.line", "line").alias("evidence"))
    text = sentence("impossible_travel", "username", "ip_a", "source_ip", "delta_seconds")
    return finding(found, DETECTOR, 3, 3, "impossible_travel", F.lit(70), text, map_of(ip_a=F.col("ip_a"), ip_b=F.col("source_ip"), delta_seconds=F.col("delta_seconds")))
