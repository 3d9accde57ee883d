"""Files that are one JSON array each, read by byte ranges: no task holds a file, however long it is.

A file is read as pieces between commas, which Spark can begin at any byte. Whether a comma parts two elements of the
outer array hangs on all that comes before it: on how many quotes are open and how deep the brackets are. So one
pass sums each block up for both cases (it begins inside a string, or not), running sums over a file's blocks say what each
begins with, and a second pass cuts the elements out. An element that lies across blocks comes in fragments, at most one
at either end of a block, which are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.sources.scratch import discard, kept

#: Blocks whose beginnings are broadcast at most; with more of them the pieces are dealt by block.
FEW_BLOCKS = 200_000

_QUOTE, _ESCAPE, _COMMA, _OPEN, _CLOSE = (ord(c) for c in '"\\,[]')
_DEEPER = np.zeros(256, np.int8)
_DEEPER[[ord("["), ord("{")]], _DEEPER[[ord("]"), ord("}")]] = 1, -1
_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x0A, 0x0D, 0x20]] = True


def _bytes(column: pa.Array) -> np.ndarray:
    """A batch's pieces as they stood in the file, a comma after each."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    ends = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.insert(raw, ends[1:] - ends[0], np.uint8(_COMMA))


def _quotes(data: np.ndarray) -> np.ndarray:
    """Where a string begins or ends: quotes that no odd number of escapes stands before."""
    quote = data == _QUOTE
    escapes = data == _ESCAPE
    if escapes.any():
        at = np.arange(len(data))
        other = np.maximum.accumulate(np.where(escapes, -1, at))  # the last byte that is no escape
        before = np.concatenate(([-1], other[:-1]))
        quote &= (at - 1 - before) % 2 == 0
    return quote


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
    """A task's rows by block: (file, block), whether the block begins here, and rows of it."""
    last = None
    for batch in batches:
        file, block = batch.column("first").to_numpy(), batch.column("block").to_numpy()
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(file)).tolist()):
            if b > a:
                name = (int(file[a]), int(block[a]))
                yield name, name != last, batch.slice(a, b - a)
                last = name


SUMMARY = "first long, block long, bytes long, quotes long, outside long, inside long, sign string"


def _summed(pieces: DataFrame) -> DataFrame:
    """One row a block: its bytes and quotes, how much deeper it ends if it begins outside or inside of a string, and its first filled byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        row = lambda x: pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in x[:6]), pa.array([x[6]], pa.string())], ["first", "block", "bytes", "quotes", "outside", "inside", "sign"])
        for name, begins, rows in _blocks(batches):
            if begins:
                if now:
                    yield row(now)
                now = [*name, 0, 0, 0, 0, None]
            data = _bytes(rows.column("value"))
            quote = _quotes(data)
            odd = (now[3] + np.cumsum(quote)) % 2 == 1
            deeper = _DEEPER[data].astype(np.int64)
            now[2] += len(data)
            now[3] += int(quote.sum())
            now[4] += int(deeper[~odd].sum())
            now[5] += int(deeper[odd].sum())
            filled = np.flatnonzero(~_BLANK[data]) if now[6] is None else ()
            if len(filled):
                now[6] = chr(data[filled[0]]) if data[filled[0]] < 128 else "?"
        if now:
            yield row(now)

    return pieces.mapInArrow(run, SUMMARY)


def _beginnings(summary: DataFrame) -> DataFrame:
    """(first, block, start, odd, depth, last): where a block's first byte stands in its file, whether it is inside a string, and how deep; last: whether the file ends with it."""
    before = Window.partitionBy("first").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    quoted = summary.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    deeper = quoted.withColumn("deeper", F.when(F.col("odd"), F.col("inside")).otherwise(F.col("outside")))
    return deeper.select(
        "first",
        "block",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"),
        "odd",
        F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("depth"),
        F.lead("block").over(Window.partitionBy("first").orderBy("block")).isNull().alias("last"),
    )


def _arrays(summary: DataFrame) -> DataFrame:
    """(first): files that begin with a bracket and close all that they open. Their last byte, a comma of ours, is not counted."""
    begin = F.min_by("sign", F.when(F.col("sign").isNotNull(), F.col("block")))
    parity = Window.partitionBy("first").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = summary.withColumn("odd", F.coalesce(F.sum("quotes").over(parity), F.lit(0)) % 2 == 1)
    totals = odd.groupBy("first").agg(begin.alias("sign"), F.sum("quotes").alias("quotes"), F.sum(F.when(F.col("odd"), F.col("inside")).otherwise(F.col("outside"))).alias("depth"), F.sum("bytes").alias("bytes"))
    return totals.filter("sign = '[' AND quotes % 2 = 0 AND depth = 0").select("first", "bytes")


CUT = "first long, place long, text string, kind string, block long"


@dataclass
class _Cutter:
    """Cuts one block's bytes into elements; what is not yet closed waits."""

    name: tuple[int, int]
    at: int  # of the next byte in the file
    odd: bool
    depth: int
    last: bool
    place: int | None = None  # where the waiting element began; None: in an earlier block
    waiting: bytes = b""
    sound: bool = True
    opened: int = 0  # arrays that begin here
    strays: list[tuple[int, int]] = field(default_factory=list)  # bytes outside of the array, with their places

    def __post_init__(self) -> None:
        self.head = self.depth > 0  # still in what an earlier block began

    def rows(self, data: np.ndarray, out: list[tuple]) -> None:
        """Cut further bytes of the block; there is one at least, the comma behind a piece."""
        quote = _quotes(data)
        inside = (int(self.odd) + np.cumsum(quote)) % 2 == 1
        deeper = np.where(inside | quote, 0, _DEEPER[data].astype(np.int64))
        depth = self.depth + np.cumsum(deeper)
        before = depth - deeper
        opens, closes = (before == 0) & (deeper == 1), (before == 1) & (deeper == -1)
        part = (data == _COMMA) & ~inside & (depth == 1)
        self.sound &= not ((opens & (data != _OPEN)).any() or (closes & (data != _CLOSE)).any() or depth.min(initial=0) < 0)
        # outside of the array: white space, and the comma that was put behind the file's last byte
        beyond = (before == 0) & (depth == 0) & ~_BLANK[data]
        stray = np.flatnonzero(beyond)
        self.strays += [(self.at + int(i), int(data[i])) for i in stray[:3]]
        raw, begin = data.tobytes(), 0
        for i in np.flatnonzero(opens | closes | part).tolist():
            if opens[i]:
                self.opened += 1
            else:
                self._put(self.waiting + raw[begin:i], out)
            self.waiting, begin = b"", i + 1
            self.place = self.at + i + 1 if not closes[i] else None
            self.head = False
        self.at, self.odd, self.depth = self.at + len(data), bool(inside[-1]), int(depth[-1])
        if self.depth > 0:
            self.waiting += raw[begin:]

    def _put(self, text: bytes, out: list[tuple]) -> None:
        out.append((self.name[0], self.place, text, "head" if self.head else "whole", self.name[1]))

    def end(self, out: list[tuple]) -> None:
        """The block is over: an element that is still open goes on in the next one."""
        if self.depth > 0:
            out.append((self.name[0], self.place, self.waiting, "middle" if self.head else "tail", self.name[1]))
        final = [c for at, c in self.strays if not (self.last and at == self.at - 1 and c == _COMMA)]
        if final or not self.sound or self.opened > 1:
            out.append((self.name[0], None, None, "bad", self.name[1]))
        elif self.opened:
            out.append((self.name[0], None, None, "opens", self.name[1]))


def _cut(pieces: DataFrame) -> DataFrame:
    """Elements and fragments of every block: whole, tail (begins here and goes on), middle and head (of one that began earlier); bad: the file is no array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, out, size = None, [], 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 5
            texts = pa.array(columns[2], pa.binary()).cast(pa.string(), safe=False)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), texts, pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64())], ["first", "place", "text", "kind", "block"])

        for name, begins, rows in _blocks(batches):
            if begins:
                if cutter:
                    cutter.end(out)
                start, odd, depth, last = (rows.column(c)[0].as_py() for c in ("start", "odd", "depth", "last"))
                cutter = _Cutter(name, start, odd, depth, last)
            cutter.rows(_bytes(rows.column("value")), out)
            size += rows.nbytes
            if size > 8 << 20:
                yield batch(out)
                out, size = [], 0
        if cutter:
            cutter.end(out)
        yield batch(out)

    return pieces.mapInArrow(run, CUT)


def array_elements(spark: SparkSession, paths: list[str], numbered: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Elements (first, place, value) of the files that are one JSON array, and those files (first, file, modified).

    numbered adds `first`, its file's number, to rows with the column `file`. The files are read twice, by
    blocks; the elements are kept in the shared folder. A file whose brackets do not match, that has more than white space
    around its array, or an element that is no JSON, is no array.
    """
    rows = spark.read.option("lineSep", ",").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = numbered(rows).select("first", "block", "value")
    summary = kept(_summed(pieces))
    listed = numbered(spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"), "modificationTime", "length"))
    # where a file ends with a comma no piece comes behind it: there are no more bytes than it has
    maybe = kept(_arrays(summary).join(listed, "first").filter("bytes <> length").select("first", "file", F.col("modificationTime").alias("modified")))
    begin = _beginnings(summary.join(maybe, "first", "left_semi"))
    if begin.count() <= FEW_BLOCKS:
        placed = pieces.join(F.broadcast(begin), ["first", "block"])
    else:
        turn = pieces.withColumn("turn", F.monotonically_increasing_id())
        placed = turn.join(begin, ["first", "block"]).repartition("first", "block").sortWithinPartitions("first", "block", "turn")
    cut = kept(_cut(placed.select("first", "block", "value", "start", "odd", "depth", "last")))
    # fragments: those of an element follow its tail
    begins = F.col("place").isNotNull()
    fragments = cut.filter("kind IN ('tail', 'middle', 'head')").withColumn("begun", F.last("place", ignorenulls=True).over(Window.partitionBy("first").orderBy("block", begins)))
    in_turn = F.transform(F.array_sort(F.collect_list(F.struct("block", begins.alias("tail"), "text"))), lambda x: x["text"])
    joined = fragments.groupBy("first", F.col("begun").alias("place")).agg(F.array_join(in_turn, "").alias("text"))
    texts = cut.filter("kind = 'whole'").select("first", "place", "text").unionByName(joined)
    held = texts.withColumn("held", F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>"))
    elements = kept(held.select("first", "place", F.when(F.size("held") == 1, F.get("held", F.lit(0))).alias("value"), F.coalesce(F.size("held") == 1, F.lit(False)).alias("sound"), (F.trim("text", F.lit(" \t\r\n")) == "").alias("blank")))
    counts = elements.groupBy("first").agg(F.count("*").alias("n"), F.count_if("blank").alias("blanks"), F.count_if(~F.col("sound")).alias("unsound"))
    signs = cut.groupBy("first").agg(F.count_if(F.col("kind") == "bad").alias("bad"), F.count_if(F.col("kind") == "opens").alias("opens"))
    sound = kept(maybe.join(counts, "first").join(signs, "first").filter("bad = 0 AND opens = 1 AND (unsound = 0 OR (n = 1 AND blanks = 1))").select("first", "file", "modified"))
    discard(summary, cut, maybe)
    return elements.filter("sound AND NOT blank").join(sound, "first", "left_semi").select("first", "place", "value"), sound
