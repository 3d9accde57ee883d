"""The two tables everything works on: normalised log entries and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One normalised log line. `ts` is the instant, `ts_local` the wall clock the line was written with.
LOG_ENTRY = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("raw", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_local", T.TimestampNTZType()),
        *(T.StructField(c, T.StringType()) for c in ("source_ip", "dest_ip", "username", "hostname", "process")),
        T.StructField("pid", T.IntegerType()),
        *(T.StructField(c, T.StringType()) for c in ("event_id", "log_level", "message", "http_method", "http_path")),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("bytes_sent", T.LongType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("log_format", T.StringType()),
        T.StructField("parse_ok", T.BooleanType()),
    ]
)

TAG = T.StructType([T.StructField(c, T.StringType()) for c in ("technique_id", "technique_name", "tactic", "url")])

#: Place of a finding in the order in which findings are merged: its rule, then up to three places within it.
ARRIVAL = T.StructType([T.StructField(c, T.LongType()) for c in ("rule_rank", "first", "second", "third")])

FINDING = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("detector", "finding_type", "description")),
        T.StructField("severity_score", T.IntegerType()),
        *(T.StructField(c, T.StringType()) for c in ("severity", "source_ip", "username")),
        T.StructField("ts", T.TimestampType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("mitre_tags", T.ArrayType(TAG)),
        T.StructField("count", T.LongType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("detector_rank", T.IntegerType()),
        T.StructField("arrival", ARRIVAL),
    ]
)


def arrival(rule_rank, first, second=0, third=0):
    """An arrival struct of columns or numbers."""
    parts = zip(ARRIVAL.fieldNames(), (rule_rank, first, second, third))
    return F.struct(*((F.lit(x) if isinstance(x, int) else x).cast("long").alias(n) for n, x in parts))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of schema: cast where they are there, null where they are not."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
