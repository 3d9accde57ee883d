"""Document fingerprints from closed syncmers.

A k-mer of characters is kept when the smallest of its s-mers lies at its first or last place. That is
decided inside the k-mer alone, so a passage gives the same anchors wherever it stands, and an edit
moves only the anchors that touch it. The fingerprint is the `size` lowest distinct anchor hashes, in
fixed-width hex: equal texts have equal fingerprints, and the share of the lowest hashes of two
fingerprints' union that both hold estimates how many anchors the texts share. The fingerprint is a sketch of
fixed size; passages are matched by all anchors with their positions (`shared_spans`).

Defined results: null text is empty; a text shorter than k is its own single anchor; an empty text has
the empty fingerprint, and two empty fingerprints are alike (1.0). Rows with the same doc_id stand next
to each other in hash order of their text. A null doc_id stands before all others. One document: it is its own next. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.llm.common import cut, discard, join_dealt, mix, parts, table

NAME = "op8_document_fingerprints"
K, S, SIZE = 16, 7, 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a null doc_id, so such rows come first.
NO_ID = -(1 << 63)


def _windows(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` values in a row, by doubling spans."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def _grams(points: np.ndarray, length: int) -> np.ndarray:
    """Hash of each `length` code points in a row."""
    out = points[: len(points) - length + 1].copy()
    for i in range(1, length):
        out *= _MULTIPLIER
        out += points[i : len(points) - length + 1 + i]
    return mix(out)


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of a text's closed syncmers, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(points) < k:
        return np.zeros(min(1, len(points)), np.int64), _grams(points, len(points)) if len(points) else points
    inner = _grams(points, s)
    width = k - s + 1
    lowest = _windows(inner, width)
    at = np.flatnonzero((inner[: len(lowest)] == lowest) | (inner[width - 1 :] == lowest))
    value = points[at]
    for i in range(1, k):
        value = value * _MULTIPLIER + points[at + i]
    return at, mix(value)


def fingerprint(text: str, k: int = K, s: int = S, size: int = SIZE) -> np.ndarray:
    """The lowest distinct anchor hashes, ascending, as 32-bit values."""
    hashes = (anchors(text, k, s)[1] >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 8 * size:  # duplicates among the lowest are few: look at a part first
        low = np.unique(np.partition(hashes, 4 * size)[: 4 * size])
        if len(low) > size:
            return low[:size]
    return np.unique(hashes)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of the union's lowest hashes that both fingerprints hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:size]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def to_text(prints: np.ndarray) -> str:
    return prints.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_neighbours(docs: DataFrame, k: int = K, s: int = S, size: int = SIZE, per_bucket: int = 250) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document (ascending doc_id, the last meets the first).

    The ids alone are cut into ranges of about per_bucket documents; texts are dealt by range, sorted
    within it and streamed, so a task holds two texts. The first document of a range goes to the range
    before it as well, so every document meets its next without a global order of texts.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    n = ids.count()
    # range bounds from quantile summaries: as many as shuffle tasks can use, so their number is bounded
    buckets = max(1, min(4 * parts(docs), n // per_bucket))
    bounds = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))}) if buckets > 1 else []
    split = np.array(bounds, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = np.searchsorted(split, batch.column("doc_id").to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], [*batch.schema.names, "bucket"])

    firsts = ids.mapInArrow(deal, "doc_id long, bucket int").groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).orderBy("bucket").collect()  # a row per range
    order = [r["bucket"] for r in firsts]
    before = {r["doc_id"]: order[i - 1] for i, r in enumerate(firsts)}  # index -1: the last range meets the first document

    def deal_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array(sorted(before), np.int64)
        for batch in batches:
            doc_id = batch.column("doc_id").to_numpy()
            bucket = np.searchsorted(split, doc_id, "right").astype(np.int32)
            names = [*batch.schema.names, "bucket", "guest"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket), pa.array(np.zeros(len(doc_id), bool))], names)
            twice = np.flatnonzero(np.isin(doc_id, keys))
            if len(twice):
                lent = batch.take(pa.array(twice))
                yield pa.RecordBatch.from_arrays([*lent.columns, pa.array([before[x] for x in doc_id[twice].tolist()], pa.int32()), pa.array(np.ones(len(twice), bool))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last = None  # bucket, doc_id, text, fingerprint still without its next
        fields = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), fields)], names)
            out.clear()
            return done

        for batch in batches:
            for bucket, guest, doc_id, text in zip(*(batch.column(c) for c in ("bucket", "guest", "doc_id", "text"))):
                bucket, guest, doc_id, text = bucket.as_py(), guest.as_py(), doc_id.as_py(), text.as_py()
                own = fingerprint(text, k, s, size)
                if last is not None and last[0] == bucket:
                    _, last_id, last_text, last_print = last
                    share = len(last_text) // 4
                    edited = last_text[: len(last_text) - share] + text[:share]
                    edited_print = fingerprint(edited, k, s, size)
                    out.append((last_id, len(last_text), hashlib.sha256(edited.encode()).hexdigest(), to_text(last_print), to_text(edited_print), likeness(last_print, edited_print, size), likeness(last_print, own, size)))
                last = None if guest else (bucket, doc_id, text, own)
            if out:
                yield flush()

    dealt = docs.mapInArrow(deal_twice, "doc_id long, text string, bucket int, guest boolean")
    # guests come last in their range; equal ids stand in hash order, only the first of them is met from before
    dealt = dealt.repartition(parts(docs), "bucket").sortWithinPartitions("bucket", "guest", "doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(run, SCHEMA).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def anchor_table(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(anchor, doc_id, position) of every closed syncmer of every text. Map-only; rows without a doc_id have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                at, value = anchors(text.as_py(), k, s)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.full(len(at), doc_id.as_py(), np.int64)), pa.array(at.astype(np.int64))], ["anchor", "doc_id", "position"])

    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long, position long")


def run_table(docs: DataFrame, length: int, k: int = K, s: int = S) -> DataFrame:
    """(run, doc_id, turn, position, ending) of every `length` closed syncmers in a row: the hash of all of them, the place of the first among the text's, and where the first and the last stand. Map-only; rows without a doc_id or a text have none."""
    names, kind = ["run", "doc_id", "turn", "position", "ending"], "run long, doc_id long, turn long, position long, ending long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                at, value = anchors(text.as_py(), k, s)
                n = len(at) - length + 1
                if n > 0:
                    columns = (_grams(value, length).view(np.int64), np.full(n, doc_id.as_py(), np.int64), np.arange(n), at[:n].astype(np.int64), at[length - 1 :].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(run, kind)


def shared_spans(docs: DataFrame, least_anchors: int = 8, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, other, offset, first, last, anchors): passages that a document shares with one of smaller doc_id, by anchors that stand at one offset without a gap.

    What is owned is a run of least_anchors anchors: by the first place of the smallest document that holds it, and the others meet that
    place alone. So a passage with n copies gives n - 1 spans, not all pairs; any two documents that share so long a passage both
    meet its owners, run by run, and none of it is lost where a third document holds bits of it. A run's rows are dealt to several tasks
    however frequent it is. first and last are positions of anchors in doc_id; the passage runs on to last + k.

    Defined results: rows without a doc_id, and null, empty and short texts, share nothing. Rows of one doc_id are not held
    against each other; a row that is there twice counts once. A passage that stands in a document twice gives a span for each
    place. No rows: no rows. Extra columns are ignored.
    """
    every = cut(run_table(docs, least_anchors, k, s))
    owners = cut(every.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "position")).alias("own")).filter("n > 1"))
    met = join_dealt(every, owners.select("run", "own"), "run", "position", owners.select("run", "n")).filter("doc_id > own.doc_id")
    met = met.select("doc_id", F.col("own.doc_id").alias("other"), (F.col("position") - F.col("own.position")).alias("offset"), "turn", "position", "ending").distinct()
    passage = ["doc_id", "other", "offset"]
    stretch = F.col("turn") - F.row_number().over(Window.partitionBy(*passage).orderBy("turn"))
    spans = met.withColumn("stretch", stretch).groupBy(*passage, "stretch").agg(F.min("position").alias("first"), F.max("ending").alias("last"), (F.count("*") + least_anchors - 1).alias("anchors"))
    found = cut(spans.drop("stretch"))
    discard(every, owners)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, beside those of their edited texts."""
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))
