"""A folder that all executors share, and tables kept there: lineage cuts that outlive executors."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set: one of our own on a single machine, an error on a cluster, whose executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_made: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("tables made", default=None)


@contextlib.contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """The tables that are kept meanwhile, by whatever operator: `discard(*tables)` removes them once their results are written."""
    tables: list[DataFrame] = []
    outer, token = _made.get(), _made.set(tables)
    try:
        yield tables
    finally:
        _made.reset(token)
        if outer is not None:
            outer += tables


def kept(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again. `discard` removes it once nothing reads it any more."""
    path = scratch(df.sparkSession, "kept")
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.kept_at = path
    if (made := _made.get()) is not None:
        made.append(table)
    return table


def once(df: DataFrame) -> DataFrame:
    """df as a table that was written, so that it is worked out once however often it is read, and its true size is known when joins are planned."""
    return df if "kept_at" in df.__dict__ else kept(df)


def _folder(table: DataFrame) -> tuple:
    """The file system and path of a table that `kept` wrote."""
    place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.kept_at)
    return place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()), place


def written_bytes(table: DataFrame) -> int:
    """Size of a table that `kept` wrote, without a job."""
    files, place = _folder(table)
    return files.getContentSummary(place).getLength()


def discard(*tables: DataFrame) -> None:
    """Remove tables that `kept` wrote; others are left alone."""
    for table in tables:
        if table.__dict__.get("kept_at"):
            files, place = _folder(table)
            files.delete(place, True)
