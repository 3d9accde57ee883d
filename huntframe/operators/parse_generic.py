"""Lines of no fixed format: JSON objects, key=value pairs, or plain text read by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.scalars import group_or_null, is_ascii, matched, once_a_row, right_trimmed, tolerant_int
from huntframe.schema import LOG_ENTRY, conform

# Other names of each field, in order of preference, and the patterns of plain text. (?dU): character
# classes and word ends are Unicode's, and only a line feed ends a line.
ALIASES = {
    "source_ip": ("src", "srcip", "client_ip", "clientip", "remote_addr", "source", "src_ip", "ipaddr", "ip_address"),
    "username": ("user", "username", "account", "usr", "user_name"),
    "hostname": ("host", "hostname", "computer", "device"),
    "http_method": ("method", "http_method", "verb"),
    "http_path": ("path", "uri", "url", "request_uri", "cs-uri-stem"),
    "http_status": ("status", "status_code", "sc-status", "response"),
    "bytes_sent": ("bytes", "bytes_sent", "sc-bytes", "size"),
    "user_agent": ("useragent", "user_agent", "ua", "agent"),
    "message": ("msg", "message", "log", "text", "description", "event"),
    "log_level": ("level", "severity", "loglevel", "log_level", "priority"),
    "timestamp": ("time", "timestamp", "@timestamp", "datetime", "ts", "eventtime", "date"),
}
PAIR = r'(?dU)\w++=(?:"[^"]*+"|\S+)'  # possessive: what follows a key or a quoted value is never part of it
TIMES = (r"(?dU)\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?", r"(?dU)\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", r"(?dU)\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}")
NAMED_ADDRESS = r"(?diU)\b(?:src|source|client|ip|addr|address|remote_ip|clientip)[\s=:]+([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"
BARE_ADDRESS = r"(?dU)\b((?:\d{1,3}\.){3}\d{1,3})\b"
NAMED_USER = r"""(?diU)\b(?:user|username|account|usr)[\s=:"]+([^\s,"']+)"""
LEVEL = r"(?diU)\b(DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|CRITICAL|FATAL|ALERT|EMERG)\b"
REQUEST = r"(?diU)\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/\S*)"
STATUS = r"(?diU)\bstatus[\s=:]+(\d{3})\b"


def time_of(text: Column) -> Column:
    """The instant of a time in any of the known forms; without an offset it is UTC."""
    s = F.trim(text)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    return F.coalesce(iso, F.try_to_timestamp(F.when(s.rlike(r"^\d{2}/\w{3}/\d{4}:"), F.substring(s, 1, 26)), F.lit("dd/MMM/yyyy:HH:mm:ss")))


def wall_clock_of(text: Column, ts: Column) -> Column:
    """The same time as it is written, without its offset; ts is its instant."""
    s = F.trim(text)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.regexp_replace(s, r"(?:Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz"))
    return F.when(ts.isNotNull(), F.coalesce(iso, ts.cast("timestamp_ntz")))


def last_wins(entries: Column) -> Column:
    """A map of key/value entries in which a later key replaces an earlier one."""
    later_first = F.reverse(entries)
    firsts = lambda es: F.filter(es, lambda e, i: F.array_position(es["key"], e["key"]) == i + 1)
    return F.map_from_entries(F.get(F.transform(F.array(later_first), firsts), 0))


def flattened(json: Column) -> Column:
    """The keys of an object and of the objects right inside it, lower-cased, as a string map."""
    flat = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    inner = lambda e: F.when(e["value"].startswith("{"), flat(F.from_json(e["value"], "map<string,string>")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    own = lambda e: F.array(F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return last_wins(F.flatten(F.transform(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: F.concat(F.coalesce(inner(e), none), own(e)))))


def pairs(text: Column) -> Column:
    """key=value and key="value" pairs as a map, keys lower-cased."""
    found = matched(is_ascii(text), PAIR, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    parts = F.transform(found, lambda x: F.struct(F.lower(F.substring_index(x, "=", 1)).alias("key"), F.substr(x, F.locate("=", x) + 1).alias("value")))
    # a value that begins and ends with a quote was read as a quoted one: with a second quote, that form comes first
    quoted = lambda v: v.startswith('"') & v.endswith('"') & (F.length(v) > 1)
    return last_wins(F.transform(parts, lambda e: F.struct(e["key"].alias("key"), F.when(quoted(e["value"]), F.substr(e["value"], F.lit(2), F.length(e["value"]) - 2)).otherwise(e["value"]).alias("value"))))


def _time_in(raw: Column) -> Column:
    """The first of the known forms of time that text holds a sound time of."""
    found = (matched(F.col("ascii"), p, lambda q: F.regexp_extract(raw, q, 0)) for p in TIMES)
    return F.coalesce(*(F.get(F.filter(F.array(t), lambda x: time_of(x).isNotNull()), 0) for t in found))


def parse_generic(lines: DataFrame) -> DataFrame:
    """Entries of (seq, value), each line by what it is: a JSON object, two or more pairs, or text. One projection, no union."""
    raw, fields, is_text = F.col("raw"), F.col("fields"), F.col("route") == "text"
    rows = _read(lines).withColumn("fields", F.when(F.col("route") == "json", flattened(raw)).otherwise(F.col("pairs")))
    # a field's value is that of the first of its names that is there and, in JSON, filled
    named = F.when(F.col("route") == "json", F.map_filter(fields, lambda _, v: ~v.isin("-", ""))).otherwise(fields)
    rows = once_a_row(rows.withColumns({"named": named, "ascii": is_ascii(raw)}), "route", "fields", "named", "ascii")
    told = {f: F.coalesce(*(F.element_at("named", n) for n in names)) for f, names in ALIASES.items()}
    found = lambda pattern, i=1: matched(F.col("ascii"), pattern, lambda p: group_or_null(raw, p, i))
    by_text = {
        "source_ip": F.coalesce(found(NAMED_ADDRESS), found(BARE_ADDRESS)),
        "username": found(NAMED_USER),
        "http_method": found(REQUEST),
        "http_path": found(REQUEST, 2),
        "log_level": found(LEVEL),
        "time": _time_in(raw),
        "http_status": matched(F.col("ascii"), STATUS, lambda p: F.regexp_extract(raw, p, 1)).try_cast("int"),
        "bytes_sent": F.lit(None).cast("long"),
        "message": F.substring(raw, 1, 500),
    }
    by_name = told | {"time": told["timestamp"], "http_status": tolerant_int(told["http_status"]), "bytes_sent": tolerant_int(told["bytes_sent"], "long"), "message": F.coalesce(told["message"], F.substring(raw, 1, 200))}
    column = lambda f: F.when(is_text, by_text.get(f)).otherwise(by_name[f]) if f in by_text else F.when(~is_text, by_name[f])
    names = ("time", "source_ip", "username", "hostname", "http_method", "http_path", "http_status", "bytes_sent", "user_agent", "message")
    extra = F.when(F.col("route") == "json", F.map_filter(fields, lambda k, _: ~k.isin(*ALIASES))).when(~is_text, fields)
    parsed = rows.select("seq", "raw", *(column(f).alias(f) for f in names), F.upper(F.coalesce(column("log_level"), F.lit("INFO"))).alias("log_level"), extra.alias("extra"), F.lit("generic").alias("log_format"), F.lit(True).alias("parse_ok"))
    timed = parsed.withColumn("ts", time_of(F.col("time")))
    return conform(timed.withColumn("ts_local", wall_clock_of(F.col("time"), F.col("ts"))), LOG_ENTRY)


def _read(lines: DataFrame) -> DataFrame:
    """(seq, raw, pairs, route): pairs are looked for in what is no JSON object and has two equals signs at least."""
    rows = lines.select("seq", right_trimmed(F.col("value")).alias("raw")).filter("raw <> ''")
    rows = rows.withColumn("is_json", F.ltrim("raw").startswith("{") & F.try_parse_json("raw").isNotNull())
    rows = rows.withColumn("pairs", F.when(~F.col("is_json") & (F.substring_index("raw", "=", 2) != F.col("raw")), pairs(F.col("raw"))))
    return rows.select("seq", "raw", "pairs", F.when(F.col("is_json"), "json").when(F.size("pairs") >= 2, "kv").otherwise("text").alias("route"))


def routed(lines: DataFrame) -> DataFrame:
    """(seq, raw, pairs, route): how each line will be read; pairs where there may be two. Blank lines are skipped."""
    return once_a_row(_read(lines), "pairs", "route")


def route_generic(lines: DataFrame) -> DataFrame:
    """(seq, route): json, kv or text."""
    return routed(lines).select("seq", "route")
