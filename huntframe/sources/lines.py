"""Log files to (seq, value) lines and to entries."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.functions.scalars import right_trimmed
from huntframe.operators.parse_generic import parse_generic
from huntframe.operators.parse_syslog import parse_syslog
from huntframe.operators.parse_web import parse_access
from huntframe.operators.parse_windows import parse_windows, windows_errors
from huntframe.sources.arrays import array_elements

#: Where a line also ends if asked to: vertical tab, form feed, the separators 1C-1E, next line, line and paragraph separator.
SEPARATORS = "[\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def _named(files: list[str], spark: SparkSession) -> DataFrame:
    """(place_of, first): for each file of a listing, by name, the first of its numbers. The driver holds the listing for any scan."""
    table = spark.createDataFrame(_firsts(files), "place_of string, first long")
    return F.broadcast(table) if len(files) <= FEW_FILES else table


def _firsts(files: list[str]) -> list[tuple[str, int]]:
    """The files by name, each with the first of its numbers."""
    shift = 63 - max(1, len(files).bit_length())
    return [(_SCHEME.sub(r"\1:/", name), at << shift) for at, name in enumerate(sorted(files))]


#: Names of files that are broadcast at most.
FEW_FILES = 100_000
#: A listing writes file:///x where a row's metadata has file:/x.
_SCHEME = re.compile("^([A-Za-z0-9+.-]+):/+")


def _place_of() -> Column:
    return F.regexp_replace("file", _SCHEME.pattern, "$1:/").alias("place_of")


def _numberer(files: list[str], spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Adds `first` to rows with the column `file`."""
    names = _named(files, spark)
    return lambda rows: rows.withColumn("place_of", _place_of()).join(names, "place_of").drop("place_of")


def _numbered(rows: DataFrame, numbered: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows (file, block, ...) with seq: rising by file name, then by place in the file.

    A file's rows are numbered from where its block begins. A block of b bytes holds at most b rows, and Spark
    gives a file's full blocks a task each, so the numbers of a file's blocks cannot meet.
    """
    placed = rows.withColumn("place", F.col("block") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return numbered(placed).withColumn("seq", F.col("first") + F.col("place"))


def read_lines(spark: SparkSession, path: str | list[str], split_separators: bool = False) -> DataFrame:
    """Text files as (seq, value, file, modified): blank lines stay, trailing white space goes. seq rises by file name and place.

    split_separators also ends lines at vertical tabs, form feeds and the Unicode line separators.
    """
    return _lines(spark, path, _numberer(spark.read.text(path).inputFiles(), spark), split_separators)


def _lines(spark: SparkSession, path: str | list[str], numbered: Callable[[DataFrame], DataFrame], split_separators: bool = False) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_modification_time").alias("modified"))
    if split_separators:
        lines = lines.withColumn("value", F.explode(F.split("value", SEPARATORS)))
    return _numbered(lines, numbered).select("seq", right_trimmed(F.col("value")).alias("value"), "file", "modified")


def read_json_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A file of one JSON event a line, as entries."""
    return parse_windows(read_lines(spark, path))


def _elements(spark: SparkSession, paths: list[str], numbered: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[int]]:
    """The elements of the files that are arrays, as (seq, value, file, modified), and those files' numbers."""
    elements, sound = array_elements(spark, paths, numbered)
    arrays = [r["first"] for r in sound.select("first").collect()]  # no more than the files, which the driver lists anyway
    files = F.broadcast(sound) if len(arrays) <= FEW_FILES else sound
    return elements.join(files, "first").select((F.col("first") + F.col("place")).alias("seq"), "value", "file", "modified"), arrays


def read_json_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files that are one JSON array of events each, as (seq, value, file, modified) with an event's JSON text. seq rises by file name and place. A file is read by blocks, whatever its size; one that is no array gives nothing."""
    files = spark.read.text(path).inputFiles()
    return _elements(spark, list(map(unquote, files)), _numberer(files, spark))[0]


def read_windows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Windows event exports as (seq, value, file, modified): a file that is one JSON array gives its elements, any other its lines.

    One pass finds the files whose first filled line begins with a bracket. Only those are read as arrays, by blocks;
    one that then is no array keeps its lines.
    """
    files = spark.read.text(path).inputFiles()
    numbered = _numberer(files, spark)
    lines = _lines(spark, path, numbered)
    begin = lines.filter("value <> ''").groupBy("file").agg(F.min_by(F.substring(F.ltrim("value"), 1, 1), "seq").alias("sign"))
    maybe = [unquote(r["file"]) for r in begin.filter("sign = '['").collect()]  # file names, which the driver lists anyway
    if not maybe:
        return lines
    elements, arrays = _elements(spark, maybe, numbered)
    if not arrays:
        return lines
    known = {name: first for name, first in _firsts(files)}
    rest = [unquote(f) for f in files if known[_SCHEME.sub(r"\1:/", f)] not in set(arrays)]
    return _lines(spark, rest, numbered).unionByName(elements) if rest else elements


def read_log(spark: SparkSession, path: str | list[str], log_format: str, split_separators: bool = False) -> DataFrame:
    """The lines of log files in a named format, ready for parse_logs and analyse."""
    return read_windows(spark, path) if log_format == "windows_event" else read_lines(spark, path, split_separators)


def parse_logs(lines: DataFrame, log_format: str, year: int | Column | None = None) -> DataFrame:
    """Entries of (seq, value) lines in a named format; a name that is not known is read as generic. year is for syslog: by default that of the file, else the current one."""
    if log_format == "apache":
        return parse_access(lines)
    if log_format == "syslog":
        return parse_syslog(lines, year)
    return parse_windows(lines) if log_format == "windows_event" else parse_generic(lines)


def run_stats(lines: DataFrame, entries: DataFrame, log_format: str) -> DataFrame:
    """(log_format, total_lines, parsed_lines, parse_errors), one row whatever the input: parsed counts every entry, errors the lines kept raw and, for Windows events, those that are JSON but no object and give no entry."""
    counts = entries.agg(F.count("*").alias("parsed_lines"), F.count_if(~F.col("parse_ok")).alias("kept_raw"))
    total = lines.agg(F.count("*").alias("total_lines"))
    errors = windows_errors(lines) if log_format == "windows_event" else counts.select(F.col("kept_raw").alias("errors"))
    return total.crossJoin(counts).crossJoin(errors).select(F.lit(log_format).alias("log_format"), "total_lines", "parsed_lines", F.col("errors").alias("parse_errors"))
