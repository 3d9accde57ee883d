"""Rules that judge one entry at a time and report by key: all of them in one pass over the log.

Each entry gives one narrow row for each rule that it meets. Those rows are grouped by rule and key, and the
evidence of the groups that are reported is the first of the same rows. Both steps combine before they
shuffle, so a key that holds most rows (or no key at all, `unknown`) is never gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.functions.scalars import severity_of
from huntframe.operators.tags import technique_url
from huntframe.schema import ARRIVAL
from huntframe.sources.scratch import kept

#: Lines shown of a group, and how much of each.
LINES, WIDTH = 5, 200


@dataclass(frozen=True)
class KeyedRule:
    """What an entry must meet, its key, and what is said about a group: in SQL over key, count, begins and ends."""

    name: str
    meets: Column | str
    key: str
    enough: str
    score: str
    text: str
    tags: tuple[tuple[str, str, str], ...]
    detector: str
    detector_rank: int
    rule_rank: int
    extra: str = "NULL"
    by_time: bool = False  # a group's first row is the earliest, not the first read
    in_turn: int | None = None  # place among rules that report in the order in which each was first met


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_hits(log: DataFrame, rules: list[KeyedRule]) -> DataFrame:
    """(rule, key, turn, seq, source_ip, username, ts, line): a row per entry and rule that it meets. Map-only."""
    own = {f"_meets{i}": r.meets for i, r in enumerate(rules) if isinstance(r.meets, Column)}
    log = log.withColumns(own) if own else log
    met = ", ".join(f"CASE WHEN {f'_meets{i}' if f'_meets{i}' in own else r.meets} THEN named_struct('rule', {i}, 'key', {r.key}, 'turn', {'ts' if r.by_time else 'cast(null AS timestamp)'}) END" for i, r in enumerate(rules))
    found = log.selectExpr("seq", "source_ip", "username", "ts", f"substring(raw, 1, {WIDTH}) AS line", f"filter(array({met}), x -> x IS NOT NULL) AS hits")
    # explode_outer: for explode Spark adds a filter on the array, and works the array out a second time for it
    return found.withColumn("hit", F.explode_outer("hits")).filter("hit IS NOT NULL").select("hit.*", "seq", "source_ip", "username", "ts", "line")


def grouped(hits: DataFrame) -> DataFrame:
    """One row per rule and key: count, time span, and the first row's address, user, time and place."""
    first = F.min_by(F.struct("source_ip", "username", "ts", "seq"), F.struct("turn", "seq")).alias("first")
    by_key = hits.groupBy("rule", "key").agg(F.count("*").alias("count"), F.min("ts").alias("begins"), F.max("ts").alias("ends"), first)
    return by_key.select("rule", "key", "count", "begins", "ends", "first.source_ip", "first.username", "first.ts", F.col("first.seq").alias("first_seq"))


def first_lines(rows: DataFrame, keys: list[str], order: list[str], most: int = LINES) -> DataFrame:
    """keys and `evidence`: the first lines of each group in order. Spark limits the groups before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = rows.select(*keys, *order, "line").withColumn("place", place).filter(F.col("place") <= most)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("evidence"))


def _by_rule(rules: list[KeyedRule], of) -> str:
    """An expression that is each rule's own; rules that share one share its branch."""
    branches: dict[str, list[str]] = {}
    for i, r in enumerate(rules):
        branches.setdefault(of(r), []).append(str(i))
    return "CASE " + " ".join(f"WHEN rule IN ({', '.join(at)}) THEN {text}" for text, at in branches.items()) + " END"


def _tags(rule: KeyedRule) -> str:
    tags = [dict(zip(("technique_id", "technique_name", "tactic", "url"), (*t, technique_url(t[0])))) for t in rule.tags]
    return "array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {quoted(v)}" for k, v in t.items()) + ")" for t in tags) + ")"


def _place(rule: KeyedRule) -> str:
    places = (rule.rule_rank, "first_seq", 0, 0) if rule.in_turn is None else (rule.rule_rank, "begun", rule.in_turn, "first_seq")
    return "named_struct(" + ", ".join(f"'{n}', cast({x} AS bigint)" for n, x in zip(ARRIVAL.fieldNames(), places)) + ")"


def keyed_findings(log: DataFrame, rules: list[KeyedRule]) -> DataFrame:
    """Findings of all the rules. The log is read once: what it holds for the rules is kept in the shared folder, and groups and evidence are read from there."""
    hits = kept(rule_hits(log, rules))
    groups = grouped(hits)
    found = groups.filter(_by_rule(rules, lambda r: r.enough))
    if any(r.in_turn is not None for r in rules):
        found = found.join(F.broadcast(groups.groupBy("rule").agg(F.min("first_seq").alias("begun"))), "rule")  # a row per rule
    columns = {
        "detector": lambda r: quoted(r.detector),
        "finding_type": lambda r: quoted(r.name),
        "description": lambda r: r.text,
        "severity_score": lambda r: f"cast(least(100, greatest(0, {r.score})) AS int)",
        "mitre_tags": _tags,
        "extra": lambda r: f"cast({r.extra} AS map<string,string>)",
        "detector_rank": lambda r: str(r.detector_rank),
        "arrival": _place,
    }
    found = found.selectExpr("rule", "key", "source_ip", "username", "ts", "count", *(f"{_by_rule(rules, of)} AS {name}" for name, of in columns.items())).withColumn("severity", severity_of(F.col("severity_score")))
    reported = hits.join(found.select("rule", "key"), ["rule", "key"], "left_semi")
    return found.join(first_lines(reported, ["rule", "key"], ["turn", "seq"]), ["rule", "key"], "left")
