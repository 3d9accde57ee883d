"""Ranked lexical search: document FP-trees, searched depth first by branch and bound.

A first pass keeps of every document its number of terms and, of the terms that any item asks for, how often each
stands in it. Document frequencies are counted over all documents, so every task weighs a term alike. A second pass
takes the documents shard by shard. For each item a shard's documents, restricted to the item's terms, go into an
FP-tree: a document's path is its terms by frequency, the rarest first, so that documents with the same beginning share it.
A node's subtree is a run of documents; the largest count of each term in it and the smallest m bound the score
of any document below, as a score grows with the count and falls with m. The search goes down the best child first and
leaves out subtrees whose bound is below the item's kth score so far; equality is followed, since ties go to the smaller
doc_id. The kth score goes on from shard to shard within a task. The tasks' best k per item are then ranked, in two steps.

The benchmark is read in blocks of items, each a bounded part of the query set that goes to all tasks; the documents
are read again for each block.

Defined results: a null or empty text has no terms and is never found; it counts nowhere. An item that is null or has no
terms finds nothing. Every row of items is an item of its own, so a repeated item_id has as many lists as rows, each with
its own ranks; repeated doc_ids are found once a row. A null doc_id comes after all others of its score. No documents or
no items: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.llm.common import LOWER, NOT_ALNUM, HashIndex, class_table, cut, hash_words, kept_by_worker, span_hashes, table, text_blocks, word_spans

NAME = "op13_ranked_search"
_IS_WORD = class_table(NOT_ALNUM)
#: Items, and bytes of their texts, that go to all tasks at once.
BLOCK_ITEMS, BLOCK_TEXT = 2000, 4 << 20
#: Documents of a shard, and cells of a tree's table of counts (documents by terms): an item of very many terms has smaller trees.
SHARD, CELLS = 16_384, 1 << 22
#: A subtree of so few documents is scored whole.
LEAF = 16
LAST_ID = (1 << 63) - 1


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), _IS_WORD)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"


def restricted_vectors(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """Of every document with a term: how many it has, and the places in `words` of those among them with their counts. Map-only."""
    shipped = docs.sparkSession.sparkContext.broadcast(hash_words(words))  # the terms of a block of items
    key_of_block = uuid.uuid4().hex

    def index() -> HashIndex:
        out = HashIndex()
        out.add(shipped.value)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_in = kept_by_worker(("terms", key_of_block), index) if len(shipped.value) else HashIndex()
        size = max(1, len(shipped.value))
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                data = LOWER[data]
                starts, ends, bounds = word_spans(data, offsets, _IS_WORD)
                term = found_in.find(span_hashes(data, starts, ends)).astype(np.int64)
                n = np.diff(bounds)
                row = np.repeat(np.arange(hi - lo), n)
                key, count = np.unique(row[term >= 0] * size + term[term >= 0], return_counts=True)
                some = np.flatnonzero(n)
                first = np.searchsorted(key, np.append(some, hi - lo) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int32))) for x in (key % size, count)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some + lo)), pa.array(n[some]), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, VECTORS)


def parts_of_score(weight: np.ndarray, count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What each term adds to a score, in whole numbers: rows are documents or bounds, columns terms."""
    count = count.astype(np.int64)
    return weight * ((1_000_000_000 * count) // (1000 * count + 8 * m[:, None]))


class Best:
    """The k best documents so far: highest score first, then the smaller doc_id."""

    def __init__(self, k: int):
        self.k, self.score, self.doc_id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.nameless = np.zeros(0, bool)  # whether the doc_id is null

    @property
    def floor(self) -> int:
        """A score below this is of no use."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc_id: np.ndarray, nameless: np.ndarray) -> None:
        use = score >= self.floor
        if use.any():
            score, doc_id, nameless = (np.concatenate((old, new[use])) for old, new in ((self.score, score), (self.doc_id, doc_id), (self.nameless, nameless)))
            order = np.lexsort((doc_id, nameless, -score))[: self.k]
            self.score, self.doc_id, self.nameless = score[order], doc_id[order], nameless[order]


class FpTree:
    """Paths of some documents' terms, the rarest first. A node is a run of paths (distinct sets of terms, in order) that begin alike."""

    def __init__(self, counts: np.ndarray, m: np.ndarray, doc_id: np.ndarray, nameless: np.ndarray):
        """counts: documents by terms, the terms rarest first; every document has one at least."""
        bits = np.packbits(counts > 0, axis=1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(">u8").astype(np.uint64)
        order = np.lexsort(bits.T[::-1])
        bits = bits[order]
        self.counts, self.m, self.doc_id, self.nameless = counts[order], m[order], doc_id[order], nameless[order]
        new = np.ones(len(order), bool)
        new[1:] = (bits[1:] != bits[:-1]).any(axis=1)
        self.first = np.append(np.flatnonzero(new), len(order))  # documents of each path
        self.most = np.maximum.reduceat(self.counts, self.first[:-1], axis=0)
        self.least_m = np.minimum.reduceat(self.m, self.first[:-1])

    def children(self, low: int, high: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the node of paths low..high that agree in their first `depth` places: the children's first paths, the places of their
        next terms (-1: the path ends here), and their subtrees' largest counts and smallest m."""
        there = self.most[low:high, depth:] > 0
        following = np.where(there.any(axis=1), depth + there.argmax(axis=1), -1)
        starts = np.flatnonzero(np.diff(following, prepend=-2))
        return low + starts, following[starts], np.maximum.reduceat(self.most[low:high], starts, axis=0), np.minimum.reduceat(self.least_m[low:high], starts)

    def search(self, weight: np.ndarray, best: Best) -> int:
        """Put every document that belongs among the best there; how many were scored."""
        scored = 0
        nodes = [(LAST_ID, 0, len(self.first) - 1, 0)]
        while nodes:
            bound, low, high, depth = nodes.pop()
            if bound < best.floor:
                continue
            a, b = self.first[low], self.first[high]
            if b - a <= LEAF or high - low == 1:
                score = parts_of_score(weight, self.counts[a:b], self.m[a:b]).sum(axis=1)
                best.add(score, self.doc_id[a:b], self.nameless[a:b])
                scored += b - a
                continue
            starts, following, most, least_m = self.children(low, high, depth)
            bounds = parts_of_score(weight, most, least_m).sum(axis=1)
            stops = np.append(starts[1:], high)
            use = np.flatnonzero(bounds >= best.floor)
            use = use[np.argsort(bounds[use], kind="stable")]  # the best is taken from the stack first
            nodes += zip(bounds[use].tolist(), starts[use].tolist(), stops[use].tolist(), (following[use] + 1).tolist())
        return scored


class Shard:
    """Restricted vectors of a bounded number of documents, term by term."""

    def __init__(self, batches: list[pa.RecordBatch], n_docs: int, n_terms: int):
        whole = pa.Table.from_batches(batches)
        ids = whole.column("doc_id")
        self.nameless = ids.is_null().to_numpy()
        self.doc_id = ids.fill_null(LAST_ID).to_numpy()
        # in Python's numbers where 64 bits might not do
        n = whole.column("n").to_numpy()
        exact = n_docs * int(n.max(initial=0)) * 75 < 1 << 62
        self.m = 25 + ((75 * n * n_docs) // n_terms if exact else np.array([75 * int(x) * n_docs // n_terms for x in n], np.int64))
        lists = whole.column("terms").combine_chunks()
        term = lists.flatten().to_numpy()
        count = whole.column("counts").combine_chunks().flatten().to_numpy()
        doc = np.repeat(np.arange(len(n), dtype=np.int32), lists.value_lengths().to_numpy())
        order = np.argsort(term, kind="stable")
        self.term, self.doc, self.count = term[order], doc[order], count[order]

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best) -> int:
        """One item, its terms rarest first: trees over runs of documents, one after the other."""
        at = list(zip(np.searchsorted(self.term, terms, "left").tolist(), np.searchsorted(self.term, terms, "right").tolist()))
        step, scored = max(1, CELLS // max(1, len(terms))), 0
        for low in range(0, len(self.m), step):
            high = min(len(self.m), low + step)
            counts = np.zeros((high - low, len(terms)), np.int32)
            for column, (a, b) in enumerate(at):
                if step < len(self.m):
                    a, b = a + np.searchsorted(self.doc[a:b], (low, high))
                counts[self.doc[a:b] - low, column] = self.count[a:b]
            some = np.flatnonzero(counts.any(axis=1))
            if len(some):
                scored += FpTree(counts[some], self.m[low:high][some], self.doc_id[low:high][some], self.nameless[low:high][some]).search(weight, best)
        return scored


Queries = list[tuple[np.ndarray, np.ndarray]]  # of each item: its terms, rarest first, and their weights


def weighted(items: list[list[int]], frequency: dict[int, int], n_docs: int) -> Queries:
    """Items' terms with w times how often the item has them. Terms that no document has, or of weight 0, add nothing and are left out."""
    out: Queries = []
    for item in items:
        rows = sorted((frequency[t], t, k) for t, k in Counter(item).items() if t in frequency)
        rows = [(t, k * w) for df, t, k in rows if (w := math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))) > 0]
        out.append((np.array([t for t, _ in rows], np.int64), np.array([w for _, w in rows], np.int64)))
    return out


def best_of_tasks(vectors: DataFrame, queries: Queries, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, task, doc_id, score): the k best documents of every task for every item of a block."""
    spark = vectors.sparkSession
    shipped = spark.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        queries, task = shipped.value, TaskContext.get().partitionId()
        best = [Best(k) for _ in queries]
        waiting: list[pa.RecordBatch] = []

        def search() -> None:
            shard = Shard(waiting, n_docs, n_terms)
            for (terms, weight), found in zip(queries, best):
                if len(terms):
                    shard.search(terms, weight, found)

        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= SHARD or sum(x.nbytes for x in waiting) > 64 << 20:
                search()
                waiting = []
        if waiting:
            search()
        item = np.repeat(np.arange(len(queries)), [len(x.score) for x in best])
        if len(item):
            ids, nameless, score = (np.concatenate([getattr(x, c) for x in best]) for c in ("doc_id", "nameless", "score"))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(np.full(len(item), task), pa.int64()), pa.array(ids, mask=nameless), pa.array(score)], ["item", "task", "doc_id", "score"])

    return vectors.mapInArrow(run, "item long, task long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, over all tasks: first over 256 tasks at a time, so no item's rows of very many tasks meet at once."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("deal", F.expr("task div 256"))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "deal").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items as (item_id, terms), a bounded block at a time."""
    block: list[tuple[int | None, list[bytes]]] = []
    size = 0
    for row in items.select("item_id", "text").toLocalIterator():
        text = row["text"] or ""
        if block and (len(block) == BLOCK_ITEMS or size + len(text) > BLOCK_TEXT):
            yield block
            block, size = [], 0
        block.append((row["item_id"], terms_of(text)))
        size += len(text)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of every item, equal scores by ascending doc_id."""
    spark, out = docs.sparkSession, None
    for block in blocks(items):
        words = sorted({t for _, terms in block for t in terms})
        place = {t: i for i, t in enumerate(words)}
        vectors = cut(restricted_vectors(docs, words))
        n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = {r["t"]: r["count"] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # terms of the block at most
        queries = weighted([[place[t] for t in terms] for _, terms in block], frequency, n_docs)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long")
        found = ranked(best_of_tasks(vectors, queries, n_docs, n_terms, k), k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH words AS (SELECT doc_id, {_TERMS} AS t FROM documents),
sized AS (SELECT row_number() OVER () AS d, doc_id, t, len(t) AS n FROM words WHERE len(t) > 0),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM sized),
counts AS (SELECT d, x AS term, count(*) AS tf FROM (SELECT d, unnest(t) AS x FROM sized) GROUP BY d, x),
freq AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
items AS (SELECT i, item_id, x AS term, count(*) AS q FROM (SELECT i, item_id, unnest(t) AS x FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark)) GROUP BY i, item_id, x),
weights AS (SELECT i, item_id, term, q * CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM items JOIN freq USING (term), totals),
scored AS (SELECT i, item_id, s.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l)))) AS BIGINT) AS score
  FROM weights JOIN counts USING (term) JOIN sized s USING (d), totals GROUP BY i, item_id, d, s.doc_id),
ranks AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranks WHERE rank <= 10
"""
