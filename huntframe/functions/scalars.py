"""Column functions that several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe import config


def severity_of(score: Column) -> Column:
    """Severity name of a 0-100 score."""
    *upper, (last, _) = config.SEVERITIES
    chain = F.lit(last)
    for name, least in reversed(upper):
        chain = F.when(score >= least, name).otherwise(chain)
    return chain


def bounded_score(score: Column) -> Column:
    """Cut toward zero and held within 0..100."""
    return F.least(F.lit(100), F.greatest(F.lit(0), score.cast("int")))


def first_filled(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty, else `unknown`."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns), F.lit("unknown"))


#: The same over the address first, and over the user first, in SQL.
ADDRESS_FIRST = "coalesce(nullif(source_ip, ''), nullif(username, ''), 'unknown')"
USER_FIRST = "coalesce(nullif(username, ''), nullif(source_ip, ''), 'unknown')"


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains one of the words; null counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def is_process(names: tuple[str, ...], process: Column | None = None) -> Column:
    """Whether the lower-cased process is exactly one of the names."""
    return F.lower(F.coalesce(F.col("process") if process is None else process, F.lit(""))).isin(*names)


def is_auth_failure(words: tuple[str, ...], processes: tuple[str, ...]) -> Column:
    """A failure word in the message of an authentication process, or a failed Windows logon."""
    return (is_process(processes) & holds_any(F.col("message"), words)) | F.coalesce(F.col("event_id") == config.FAILED_LOGON_EVENT, F.lit(False))


def is_off_hours(day_begins: int, day_ends: int) -> Column:
    """Whether the wall clock stands outside the business day."""
    hour = F.hour("ts_local")
    return (hour < day_begins) | (hour >= day_ends)


def is_weekend_sensitive() -> Column:
    """A sensitive process or event on a Saturday or Sunday."""
    return (F.weekday("ts_local") >= 5) & (is_process(config.SENSITIVE_PROCESSES) | F.coalesce(F.col("event_id").isin(*config.WEEKEND_EVENTS), F.lit(False)))


def format_duration(seconds: Column) -> Column:
    """`2h 5m`, or `5m` below an hour."""
    minutes = F.floor(seconds / 60).cast("long")
    hours, rest = F.floor(minutes / 60).cast("long"), minutes % 60
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m"))).otherwise(F.concat(rest.cast("string"), F.lit("m")))


def map_of(**entries: Column) -> Column:
    """A string map of the entries whose value is not null."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in entries.items()))
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


#: What Python's str.rstrip takes for white space.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: U+FDD0 is no character. It parts the groups of a matched line; a line that holds it is read without it.
MARK = "\ufdd0"


def right_trimmed(text: Column) -> Column:
    """text without the white space, Unicode's as well, at its end."""
    return F.rtrim(text, F.lit(WHITE))


def is_ascii(text: Column) -> Column:
    """Whether text has no more bytes than characters."""
    return F.octet_length(text) == F.length(text)


def ascii_twin(pattern: str) -> str:
    """A pattern without Unicode's classes and case: in ASCII text it means the same, and is matched many times faster."""
    return re.sub(r"^\(\?(\w+)\)", lambda flags: f"(?{flags[1].replace('U', '')})", pattern)


def matched(ascii_: Column, pattern: str, use: Callable[[str], Column]) -> Column:
    """use(pattern), or use(the pattern's ASCII twin) where the text is ASCII. Give a column as ascii_: it is read wherever a pattern is tried."""
    return F.when(ascii_, use(ascii_twin(pattern))).otherwise(use(pattern))


def once_a_row(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with these columns worked out once. A filter on what follows from them is not pushed below this step, where Spark would write
    them out anew at every place that reads them."""
    return rows.select(*(c for c in rows.columns if c not in columns), F.inline_outer(F.array(F.struct(*columns))))


def marked(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern that matches all of text, with marks between them; text itself where it does not match. So a line is matched once, however many groups are read."""
    parts = MARK.join(f"${i}" for i in range(1, groups + 1))
    bare = F.replace(text, F.lit(MARK), F.lit(""))
    return F.when(is_ascii(text), F.regexp_replace(text, ascii_twin(pattern), parts)).otherwise(F.regexp_replace(bare, pattern, parts))


def is_marked(told: Column) -> Column:
    return F.contains(told, F.lit(MARK))


def parted(told: Column) -> Column:
    """The groups of what `marked` gives, as an array; null where nothing matched."""
    return F.when(is_marked(told), F.split(told, MARK))


def group_or_null(text: Column, pattern: str, group: int) -> Column:
    """A regex group; null where the pattern does not match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def tolerant_int(text: Column, kind: str = "int") -> Column:
    """An integer if the text is one but for spaces around it, else null."""
    return F.trim(text).try_cast(kind)
