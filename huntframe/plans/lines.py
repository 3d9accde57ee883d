"""Events written as lines of each format, with some lines that are broken on purpose; the parse queries read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def access_lines(log: DataFrame) -> DataFrame:
    """Access lines; of 50, two are error-log lines (one with a fraction in its time), one is broken and one blank."""
    at = F.col("seq") % 50
    value = (
        F.when(at == 0, F.concat(F.lit("[Thu Oct 10 13:55:36 2024] [error] [pid 12] "), "message"))
        .when(at == 1, F.concat(F.lit("[Thu Oct 10 13:55:36.123456 2024] [warn] "), "message"))
        .when(at == 2, F.concat(F.lit("broken "), F.col("seq").cast("string")))
        .when(at == 3, F.lit("  "))
        .otherwise(F.col("raw"))
    )
    return log.select("seq", value.alias("value"))


def syslog_lines(log: DataFrame) -> DataFrame:
    """Syslog lines; of 10, one in the newer form, one broken, one comment, and five with messages that name users in other ways."""
    at = F.col("seq") % 10
    message = (
        F.when(at == 4, F.concat(F.lit("Invalid user "), "username", F.lit(" from "), "source_ip"))
        .when(at == 5, F.concat(F.lit("Accepted publickey for "), "username", F.lit(" from "), "source_ip", F.lit(" port 22")))
        .when(at == 6, F.concat(F.lit("su: FAILED SU (to root) x to root by "), "username"))
        .when(at == 7, F.concat(F.lit("new user: name="), "username"))
        .when(at == 8, F.concat(F.lit("warn: link from "), "source_ip"))
        .otherwise(F.concat(F.lit("Failed password for "), "username", F.lit(" from "), "source_ip"))
    )
    host = F.concat(F.lit("host"), (F.col("seq") % 3).cast("string"))
    old = F.concat(F.date_format("ts_local", "MMM dd HH:mm:ss"), F.lit(" "), host, F.lit(" "), "process", F.lit("["), F.col("seq").cast("string"), F.lit("]: "), message)
    new = F.concat(F.lit("<34>1 "), F.date_format("ts_local", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), host, F.lit(" "), "process", F.lit(" 77 ID47 - "), message)
    value = F.when(at == 1, new).when(at == 2, F.concat(F.lit("broken "), F.col("seq").cast("string"))).when(at == 3, F.lit("# a comment")).otherwise(old)
    return log.select("seq", value.alias("value"))


def windows_lines(log: DataFrame) -> DataFrame:
    """Event records; of 10, three in other layouts, one no JSON, one JSON but no object."""
    at = F.col("seq") % 10
    time = F.date_format("ts_local", "yyyy-MM-dd'T'HH:mm:ss")
    code = F.element_at(F.array(*map(F.lit, ("4624", "4625", "4720", "9999", "1102"))), (F.col("seq") % 5).cast("int") + 1)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) and not p.startswith("$") else (F.col(p[1:]) if isinstance(p, str) else p) for p in parts))
    main = text('{"EventID": "', code, '", "TimeCreated": "', time, 'Z", "Computer": "h1", "EventData": {"TargetUserName": "', "$username", '", "SubjectUserName": "", "IpAddress": "', "$source_ip", '", "LogonType": "10", "ProcessName": "lsass.exe"}}')
    value = (
        F.when(at == 1, text('{"event_id": 4625, "timestamp": "', time, '+02:00", "hostname": "h2", "event_data": {"SubjectUserName": "SYSTEM", "TargetUserName": "', "$username", '", "IpAddress": "-"}}'))
        .when(at == 2, text('{"System": {"EventID": "4688", "Computer": "h3", "Level": "2", "Security": {"UserID": "', "$username", '"}, "TimeCreated": {"#attributes": {"SystemTime": "', time, '.1234567Z"}}}}'))
        .when(at == 3, text('{"EventID": 4740, "@timestamp": "', time, '.123Z", "UserData": {"WorkstationName": "::1", "SubjectUserName": " ', "$username", ' "}}'))
        .when(at == 4, F.lit("no json at all"))
        .when(at == 5, F.lit("[1, 2]"))
        .otherwise(main)
    )
    return log.select("seq", value.alias("value"))


def generic_lines(log: DataFrame) -> DataFrame:
    """Lines of four kinds in turn: a nested JSON object, pairs, plain text, and text with one pair only."""
    at = F.col("seq") % 4
    time = F.date_format("ts_local", "yyyy-MM-dd HH:mm:ss")
    status = F.col("http_status").cast("string")
    json = F.concat(F.lit('{"src": "-", "client_ip": "'), "source_ip", F.lit('", "Net": {"User": "'), "username", F.lit('", "Zone": "dmz"}, "status": '), status, F.lit(', "url": "'), "http_path", F.lit('", "time": "'), time, F.lit('", "level": "warn", "size": "x1"}'))
    kv = F.concat(F.lit("SRC="), "source_ip", F.lit(' user="'), "username", F.lit('" status='), status, F.lit(" bytes="), F.col("bytes_sent").cast("string"), F.lit(" uri="), "http_path", F.lit(" time="), F.date_format("ts_local", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z msg="two words"'))
    text = F.concat(time, F.lit(" client "), "source_ip", F.lit(" error for user "), "username", F.lit(": "), "http_method", F.lit(" "), "http_path", F.lit(" status="), status)
    lone = F.concat(F.lit("seen "), "source_ip", F.lit(" k="), F.col("seq").cast("string"), F.lit(" notice"))
    return log.select("seq", F.when(at == 0, json).when(at == 1, kv).when(at == 2, text).otherwise(lone).alias("value"))
