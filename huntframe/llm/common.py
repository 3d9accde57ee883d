"""Pieces that several corpus operators share: tables, lineage cuts and byte-level word scans."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.sources.scratch import discard, kept as cut

__all__ = ["cut", "discard"]  # tables in the shared folder, written and removed

#: Text handled at a time inside a task; a single longer document is a block of its own.
BLOCK_BYTES = 1 << 19


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are long: fewer rows go to Python at a time than Spark's 10,000, unless the session has a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Ids that are broadcast at most, to pick rows by: about 100 MB.
FEW_IDS = 2_000_000


def only(rows: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """The rows whose column is in ids (one column, distinct; left_anti: is not). Few ids are broadcast, so that no row is shuffled; more are joined."""
    ids = ids.toDF(column)
    return rows.join(F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids, column, how)


def join_dealt(rows: DataFrame, side: DataFrame, key: str, other: str, sizes: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined to side, which has one row a key, without a hot key.

    A key that holds more rows than a quarter of a task's share is dealt to several tasks by the column other, and
    its row of side is repeated for each. There are at most four such keys a task, whatever the table, so they go
    along as a list. rows is read twice; sizes (key, n) are its counts by key, where they are known.
    """
    n = rows.count()
    share = max(64, n // (4 * parts(rows)))
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")) if sizes is None else sizes.select(key, "n")
    level = F.ceil(F.log2(F.col("n") / share)).cast("int")  # so many tasks, as a power of two
    hubs: dict[int, list] = {}
    for row in sizes.filter((F.col("n") > share) & F.col(key).isNotNull()).select(key, level.alias("level")).collect():
        hubs.setdefault(row["level"], []).append(row[key])
    deals = F.lit(1)
    for at, keys in sorted(hubs.items()):
        deals = F.when(F.col(key).isin(keys), 1 << at).otherwise(deals)
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(other), deals.cast("long")))
    repeated = side.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), deals.cast("long") - 1)))
    return dealt.join(repeated, [key, "_deal"], how).drop("_deal")


def class_table(separators: bytes) -> np.ndarray:
    """256 flags: False for the separator bytes, True for all others (every byte of a non-ASCII character is a word byte)."""
    flags = np.ones(256, dtype=bool)
    flags[np.frombuffer(separators, dtype=np.uint8)] = False
    return flags


#: What `[^\x20\x09-\x0D]+` splits at.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: What `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` splits at, once A-Z are lower-cased.
NOT_ALNUM = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
#: Byte map that lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LOWER_BYTES = LOWER.tobytes()


def byte_of_char() -> dict[str, int]:
    """The byte that each character of byte-level token strings stands for: printable Latin-1 stands for itself, the rest for characters from U+0100 on, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows lo..hi of a string column with their UTF-8 bytes and row offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each row's first word (with a last entry: all words). Words never cross rows."""
    inside = is_word[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes have equal hashes wherever they stand."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_GOLDEN))


def hash_words(words: list[bytes]) -> np.ndarray:
    """The same hash for words that are given one by one."""
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return span_hashes(data, ends - np.array([len(w) for w in words], np.int64), ends) if words else np.zeros(0, np.uint64)


_kept: dict = {}


def kept_by_worker(key, build):
    """What build() makes, kept in this Python worker for its next tasks; only the latest key is kept, so stages that follow each other do not add up."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # what the C library holds on to, where it can be told
            ctypes.CDLL(None).malloc_trim(0)
        _kept[key] = build()
    return _kept[key]


class HashIndex:
    """Rows by 64-bit hash: open addressing in arrays, whole batches at a time."""

    def __init__(self, bits: int = 12):
        self._room(bits)
        self.n = 0

    def _room(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        at = (hashes >> self.shift).astype(np.int64)
        found = self.values[at]
        left = np.flatnonzero((self.keys[at] != hashes) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found[left] = self.values[at[left]]
            left = left[(self.keys[at[left]] != hashes[left]) & (found[left] >= 0)]
        return found

    def add(self, hashes: np.ndarray) -> None:
        """Give new, distinct hashes the next rows, in order."""
        if 2 * (self.n + len(hashes)) > len(self.keys):
            old, rows = self.keys[self.values >= 0], self.values[self.values >= 0]
            self._room(int(np.ceil(np.log2(3 * (self.n + len(hashes))))))
            self._put(old, rows)
        self._put(hashes, np.arange(self.n, self.n + len(hashes), dtype=np.int32))
        self.n += len(hashes)

    def _put(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        at = (hashes >> self.shift).astype(np.int64)
        while len(at):
            free = np.flatnonzero(self.values[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = hashes[won], rows[won]
            lost = np.ones(len(at), bool)
            lost[won] = False
            hashes, rows, at = hashes[lost], rows[lost], (at[lost] + 1) & self.mask


class WordMemo:
    """What a task has worked out for each distinct word so far, by hash; forgotten and begun anew at `limit` words.

    Subclasses give learn(words), which appends the results of new words in order, and forget().
    """

    limit = 350_000

    def __init__(self) -> None:
        self.index = HashIndex()
        self.forget()

    def forget(self) -> None:
        raise NotImplementedError

    def learn(self, words: list[bytes]) -> None:
        raise NotImplementedError

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of each word's results; new words are learnt first, in sorted order."""
        if self.index.n > self.limit:
            self.index = HashIndex()
            self.forget()
        hashes = span_hashes(data, starts, ends)
        found = self.index.find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            raw, at = data.tobytes(), new[first]
            words = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            order = sorted(range(len(words)), key=words.__getitem__)
            self.index.add(distinct[order])
            self.learn([words[i] for i in order])
            found[new] = self.index.find(hashes[new])
        return found


def grown(array: np.ndarray, n: int) -> np.ndarray:
    """array with room for n rows, doubled as needed."""
    while len(array) < n:
        array = np.concatenate((array, np.zeros_like(array)))
    return array


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; empty ranges sum to 0."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=sums[1:], dtype=sums.dtype)
    return sums[bounds[1:]] - sums[bounds[:-1]]
