"""Windows event records in JSON, in any of three layouts, to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.scalars import map_of, right_trimmed
from huntframe.schema import LOG_ENTRY, conform

# Names of events, logon types and levels.
EVENT_NAMES = {
    "4624": "Successful Logon", "4625": "Failed Logon", "4634": "Logoff", "4648": "Logon with Explicit Credentials", "4656": "Handle to Object Requested",
    "4663": "Object Access Attempted", "4672": "Special Privileges Assigned to New Logon", "4688": "Process Created", "4698": "Scheduled Task Created",
    "4700": "Scheduled Task Enabled", "4719": "System Audit Policy Changed", "4720": "User Account Created", "4726": "User Account Deleted",
    "4728": "Member Added to Security-Enabled Global Group", "4732": "Member Added to Security-Enabled Local Group", "4740": "User Account Locked Out",
    "4756": "Member Added to Security-Enabled Universal Group", "4776": "Credential Validation", "4798": "User's Local Group Membership Enumerated",
    "4799": "Security-Enabled Local Group Membership Enumerated", "7045": "New Service Installed", "1102": "Audit Log Cleared", "4616": "System Time Changed", "4657": "Registry Value Modified",
}
LOGON_TYPES = {"2": "Interactive", "3": "Network", "4": "Batch", "5": "Service", "7": "Unlock", "8": "NetworkCleartext", "9": "NewCredentials", "10": "RemoteInteractive (RDP)", "11": "CachedInteractive"}
LEVELS = {"0": "INFO", "1": "CRITICAL", "2": "ERROR", "3": "WARNING", "4": "INFO", "5": "DEBUG"}
NO_ADDRESS = ("-", "::1", "127.0.0.1")
NO_NAME = ("-", "", "N/A", "SYSTEM", "LOCAL SERVICE")


def lookup(names: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), key)


# The fields of a record, of its System part and of its data.
RECORD = ("EventID", "event_id", "TimeCreated", "timestamp", "@timestamp", "Computer", "hostname", "username", "source_ip", "EventData", "event_data", "UserData", "System")
SYSTEM = ("EventID", "Computer", "Level", "Security", "TimeCreated")
DATA = ("TargetUserName", "SubjectUserName", "IpAddress", "WorkstationName", "LogonType", "NewProcessName", "ProcessName", "CommandLine", "TaskName", "ServiceName", "PrivilegeList")


def read_fields(json: Column, names: tuple[str, ...]) -> Column:
    """The named fields of a JSON object as text, in one reading; a nested value is its JSON text."""
    return F.from_json(json, ", ".join(f"`{n}` string" for n in names))


def first_of(*values: Column) -> Column:
    """The first value that is there and neither empty text nor an empty object."""
    return F.coalesce(*(F.when((v != "") & (v != "{}"), v) for v in values))


def clean_address(address: Column) -> Column:
    """Null for a dash and loopback."""
    return F.when(~address.isin(*NO_ADDRESS), address)


def clean_name(name: Column) -> Column:
    """Trimmed; null for placeholders and system accounts."""
    trimmed = F.trim(name)
    return F.when(~trimmed.isin(*NO_NAME), trimmed)


def event_name(event_id: Column, logon_type: Column) -> Column:
    """What an event is called, with its logon type in brackets."""
    name = F.coalesce(lookup(EVENT_NAMES, event_id), F.concat(F.lit("Event "), event_id))
    return F.concat(name, F.when(F.coalesce(logon_type, F.lit("")) != "", F.concat(F.lit(" ["), F.coalesce(lookup(LOGON_TYPES, logon_type), logon_type), F.lit("]"))).otherwise(""))


def cut_time(text: Column) -> Column:
    """What is read of a record's time: its first 26 characters, so a Z behind more than six digits of a fraction is lost and the time with it. Null where the rest is no time."""
    cut = F.substring(text, 1, 26)
    iso = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:(?:\.\d{1,6})?Z|[+-]\d{2}:?\d{2})| \d{2}:\d{2}:\d{2})$"
    return F.when(cut.rlike(iso) | cut.rlike(r"^\d+/"), cut)


def event_time(cut: Column) -> Column:
    """The instant of a time that `cut_time` gave."""
    colon = F.regexp_replace(cut, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.coalesce(F.when(F.substring(cut, 5, 1) == "-", F.when(F.length(cut) > 19, colon).otherwise(cut).try_cast("timestamp")), F.when(F.contains(cut, F.lit("/")), F.try_to_timestamp(cut, F.lit("M/d/yyyy h:mm:ss a"))))


def parse_windows(lines: DataFrame) -> DataFrame:
    """Entries of (seq, value), one JSON object a line. What is no JSON is kept raw with parse_ok false; JSON that is no object gives no entry (see windows_errors).

    A record is read once, and so are its data and its System part.
    """
    rows = lines.select("seq", right_trimmed(F.col("value")).alias("raw")).filter("raw <> ''")
    braced, valid = F.ltrim("raw").startswith("{"), F.try_parse_json("raw").isNotNull()
    rows = rows.filter(braced | ~valid).withColumn("parse_ok", braced & valid)
    r, s, d = (lambda name, of=of: F.col(of)[name] for of in ("record", "system", "data"))
    read = rows.select("seq", "raw", "parse_ok", F.when(F.col("parse_ok"), read_fields(F.col("raw"), RECORD)).alias("record"))
    read = read.select("seq", "raw", "parse_ok", "record", read_fields(r("System"), SYSTEM).alias("system"), read_fields(first_of(r("EventData"), r("event_data"), r("UserData")), DATA).alias("data"))
    filled = lambda c: F.nullif(c, F.lit(""))
    nested = F.get_json_object(s("TimeCreated"), "$['#attributes'].SystemTime")
    told = read.select(
        "seq",
        "raw",
        "parse_ok",
        "data",
        F.when(F.col("parse_ok"), F.coalesce(first_of(r("EventID"), r("event_id"), s("EventID")), F.lit(""))).alias("event_id"),
        cut_time(first_of(r("TimeCreated"), r("timestamp"), r("@timestamp"), nested)).alias("time"),
        clean_address(F.coalesce(filled(d("IpAddress")), filled(d("WorkstationName")), first_of(r("source_ip")))).alias("source_ip"),
        clean_name(F.coalesce(filled(d("SubjectUserName")), filled(d("TargetUserName")), first_of(r("username"), F.get_json_object(s("Security"), "$.UserID")))).alias("username"),
        first_of(s("Computer"), r("Computer"), r("hostname")).alias("hostname"),
        F.coalesce(filled(d("NewProcessName")), filled(d("ProcessName"))).alias("process"),
        F.when(F.col("parse_ok"), F.coalesce(lookup(LEVELS, F.coalesce(s("Level"), F.lit("4"))), F.lit("INFO"))).alias("log_level"),
    )
    told = told.withColumns({"ts": event_time(F.col("time")), "wall": F.regexp_replace("time", r"(?:Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz"), "name": event_name(F.col("event_id"), d("LogonType"))})
    logon = F.coalesce(lookup(LOGON_TYPES, d("LogonType")), filled(d("LogonType")))
    extra = map_of(logon_type=logon, event_id_human=F.col("name"), command_line=d("CommandLine"), target_user=d("TargetUserName"), subject_user=d("SubjectUserName"), task_name=d("TaskName"), service_name=d("ServiceName"), privilege_list=d("PrivilegeList"))
    parsed = told.withColumns({"ts_local": F.when(F.col("ts").isNotNull(), F.coalesce("wall", F.col("ts").cast("timestamp_ntz"))), "message": F.coalesce("name", "raw"), "extra": F.when(F.col("parse_ok"), extra), "log_format": F.lit("windows_event")})
    return conform(parsed, LOG_ENTRY)


def windows_errors(lines: DataFrame) -> DataFrame:
    """(errors): lines that are no JSON object, kept or not."""
    raw = right_trimmed(F.col("value"))
    bad = F.try_parse_json(raw).isNull() | ~F.ltrim(raw).startswith("{")
    return lines.filter(raw != "").agg(F.count_if(bad).alias("errors"))
