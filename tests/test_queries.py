"""Every registered log query against its SQL, on the smallest tables."""

import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("events", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def _names():
    from huntframe import catalog

    return sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, db, tmp_path, name):
    from huntframe import catalog

    catalog.queries()[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    ours, theirs = f"SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')", catalog.oracle_sql()[name]
    columns = sorted(db.sql(ours).columns)
    assert columns == sorted(db.sql(theirs).columns)
    listed = ", ".join(columns)
    assert db.sql(f"SELECT count(*) FROM ({ours})").fetchall() == db.sql(f"SELECT count(*) FROM ({theirs})").fetchall()
    assert db.sql(f"SELECT {listed} FROM ({ours}) EXCEPT ALL SELECT {listed} FROM ({theirs})").fetchall() == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_streams_agree_with_batch(spark, tmp_path):
    from huntframe.fixtures import events_log
    from huntframe.operators.statistical import error_rate_windows, requests_per_minute
    from huntframe.streaming.windows import stream_error_rate_windows, stream_requests_per_minute

    source = events_log(spark, DATA)
    source.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "log"))
    for name, job in (("rpm", stream_requests_per_minute), ("errors", stream_error_rate_windows)):
        query = job(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    # what can still change is not out yet: the last ten minutes, and the windows that reach into them
    closed = source.agg(F.date_trunc("second", F.max("ts_local")) - F.expr("INTERVAL 10 MINUTES")).first()[0]
    by_minute = {(r.source_ip, r.minute, r.requests) for r in requests_per_minute(source).collect() if r.minute + timedelta(minutes=1) <= closed}
    assert {tuple(r) for r in spark.table("rpm").collect()} == by_minute and by_minute
    windows = {(r.window_start, r.total, r.errors, r.error_pct) for r in error_rate_windows(source).collect() if r.window_start + timedelta(minutes=5) <= closed}
    assert {tuple(r) for r in spark.table("errors").collect()} == windows and windows
