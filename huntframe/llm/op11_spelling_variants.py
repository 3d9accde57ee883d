"""Spelling variants: words one edit apart, found by walking a distributed trie level by level.

The dictionary's words go into two tries, one of the words and one of the words read backwards; their edges are a
table (node, c, child), with the code points that may follow either node. States (id, node, rest) say that a word's beginning, with one edit, spells the path to a node,
and what of the word is still to come. Each word stands, without an edit, on every node of its own path; from there
one edit leads to the node's children (a code point put in, or in place of the next one) or leaves out the next one.
Then all states go one level down together: a join with the edge table on node and next code point, until the word is
used up. A state that then stands on the last node of a word has found a neighbour. None is made where the next code point
cannot follow its node.

An edit in the second half of a word is looked for forwards, one in the first half backwards, so that no state sets
out from the crowded top of a trie. Nodes are named by a hash of their path modulo the prime 2**61 - 1, so the node at
the end of a path can be told from any node on it: words of more than WALKED code points go there in one stride. A
collision would merge two nodes.

A word's form is its neighbour of largest count, if that has `ratio` times the word's; forms' counts grow along a chain,
so following them ends, and pointer doubling follows all chains at once.

Defined results: a null or empty text has no words. A null doc_id counts as an empty one in the rule that spoils runs.
Repeated rows count as often as they stand there. Ties between forms go to the smaller word in code-point order. No
words: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.llm.common import LOWER, WordMemo, class_table, cut, discard, grown, table, text_blocks, word_spans

NAME = "op11_spelling_variants"
_LETTERS = np.zeros(256, bool)
_LETTERS[0x61:0x7B] = True
#: The lead byte of U+00C0 to U+00FF; any byte may follow.
_LATIN = 0xC3
_IS_WORD = class_table(b" ")
#: Follows a node where a word ends; no letter.
END = "\x00"
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
#: Where the tries begin: forwards, backwards.
ROOTS = (1, 2)
#: Longer words do not walk, but stride to the end.
WALKED = 40
#: States or edges that are broadcast at most; more are joined by a shuffle.
FEW_ROWS = 400_000


class RunCounter(WordMemo):
    """Counts of the distinct runs that a task has met; given out and begun anew at `limit` of them."""

    limit = 150_000

    def forget(self) -> None:
        self.words: list[bytes] = []
        self.count = np.zeros(1024, np.int64)
        self.changed: Counter = Counter()

    def learn(self, words: list[bytes]) -> None:
        self.words += words
        self.count = grown(self.count, len(self.words))

    def flush(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.count[: len(self.words)])
        words = [self.words[i].decode() for i in some.tolist()] + list(self.changed)
        counts = np.concatenate((self.count[some], np.fromiter(self.changed.values(), np.int64, len(self.changed))))
        self.count[:] = 0
        self.changed.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts)], ["word", "n"])


def run_spans(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every maximal run of `[A-Za-z\\u00C0-\\u00FF]` of at least so many code points; data is lower-cased."""
    lead = data == _LATIN
    inside = _LETTERS[data] | lead
    inside[1:] |= lead[:-1]
    starts, ends, bounds = word_spans(np.where(inside, data, 0x20).astype(np.uint8), offsets, _IS_WORD)
    leads = np.concatenate(([0], np.cumsum(lead)))
    some = ends - starts - (leads[ends] - leads[starts]) >= least
    return np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))[some], starts[some], ends[some]


def spoilt(word: bytes, h: int) -> str:
    """The run without its code point h % length."""
    text = word.decode()
    at = h % len(text)
    return text[:at] + text[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, spoil: int = 199) -> DataFrame:
    """(word, n): lower-cased runs of at least so many code points and occurrences, with the contract's seeded misspellings (every `spoil`-th run of a document loses a code point)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = RunCounter()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                if counter.index.n > counter.limit or len(counter.changed) > counter.limit:
                    yield counter.flush()
                data = LOWER[data]
                row, starts, ends = run_spans(data, offsets, least_length)
                word = counter.rows(data, starts, ends)
                pairs, times = np.unique(row * len(counter.words) + word, return_counts=True)
                row, word = np.divmod(pairs, max(1, len(counter.words)))
                begin = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[lo:hi]]
                words, crc32 = counter.words, zlib.crc32
                h = np.fromiter((crc32(words[w], begin[r]) for r, w in zip(row.tolist(), word.tolist())), np.int64, len(row))
                hit = h % spoil == 0
                counter.count[: len(words)] += np.bincount(word[~hit], times[~hit], len(words)).astype(np.int64)
                for w, k, x in zip(word[hit].tolist(), times[hit].tolist(), h[hit].tolist()):
                    text = spoilt(words[w], x)
                    if len(text) >= least_length:
                        counter.changed[text] += k
        yield counter.flush()

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def path(root: int, word: str) -> list[int]:
    """Nodes of a word's path, the root first."""
    out = [root]
    for c in word:
        out.append((out[-1] * BASE + ord(c) + 1) % PRIME)
    return out


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def named(counts: DataFrame) -> DataFrame:
    """(id, backwards, word, n): the last nodes of a word in the two tries; the first is the word's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            ends = [pa.array([path(root, w[::step])[-1] for w in words], pa.int64()) for root, step in zip(ROOTS, (1, -1))]
            yield pa.RecordBatch.from_arrays([*ends, batch.column("word"), batch.column("n")], ["id", "backwards", "word", "n"])

    return counts.select("word", "n").mapInArrow(run, "id long, backwards long, word string, n long")


def edge_table(words: DataFrame, least_depth: int) -> DataFrame:
    """(node, c, child, beside, below): the edges of both tries below nodes of at least a depth; no word sets out above it.

    beside, below: which code points may follow the node and the child, END among them where a word ends there: a set of
    their remainders by 64, as bits. Two that share a remainder only make a state that the next join ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for word in batch.column("word").to_pylist():
                for root, way in zip(ROOTS, (word, word[::-1])):
                    nodes = path(root, way)
                    rows.update((nodes[i], way[i], nodes[i + 1]) for i in range(least_depth, len(way)))
                    rows.add((nodes[-1], END, 0))
            yield _batch(list(rows), ["node", "c", "child"], [pa.int64(), pa.string(), pa.int64()])

    edges = cut(words.select("word").mapInArrow(run, "node long, c string, child long").distinct())
    nodes = cut(edges.groupBy("node").agg(F.bit_or(_bit(F.col("c"))).alias("beside")))
    below = nodes.select(F.col("node").alias("child"), F.col("beside").alias("below"))
    full = cut(edges.filter(F.col("c") != END).join(nodes, "node").join(below, "child").select("node", "c", "child", "beside", "below"))
    discard(edges, nodes)
    return full


STATE = "id long, node long, rest string, times long, plus long"


def unedited(words: DataFrame) -> DataFrame:
    """Every word on the nodes of its own path, from the middle on, both ways.

    rest: the code points to come, of a word that walks. A word that strides has the next two at most, and the factor and
    the summand that lead from the node after one of them to the end; (times, plus) is null otherwise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for own, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
                half = len(word) // 2
                for root, way, begin in ((ROOTS[0], word, half), (ROOTS[1], word[::-1], len(word) - half)):
                    nodes = path(root, way)
                    if len(word) <= WALKED:
                        rows += [(own, nodes[i], way[i:], None, None) for i in range(begin, len(way) + 1)]
                        continue
                    times, plus = 1, 0  # of what follows place i
                    for i in range(len(way), begin - 1, -1):
                        rows.append((own, nodes[i], way[i : i + 2], times, plus))
                        if i > begin:
                            plus = (plus + times * (ord(way[i - 1]) + 1)) % PRIME
                            times = times * BASE % PRIME
                    if len(rows) > 100_000:
                        yield _batch(rows, ["id", "node", "rest", "times", "plus"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])
                        rows = []
            yield _batch(rows, ["id", "node", "rest", "times", "plus"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])

    return words.select("id", "word").mapInArrow(run, STATE)


def _joined(states: DataFrame, edges: DataFrame, on: list[str], n: int) -> DataFrame:
    """States with the edges that they meet; few states go to the edges, so that those stay where they are."""
    return edges.join(F.broadcast(states) if n <= FEW_ROWS else states, on)


def _next(place: int) -> Column:
    """The code point of rest at a place, END behind its last one."""
    c = F.substring("rest", place, 1)
    return F.when(c == "", END).otherwise(c)


def _bit(c: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c).bitwiseAND(63))


def _follows(c: Column, allowed: str) -> Column:
    return F.col(allowed).bitwiseAND(_bit(c)) != 0


def one_edit(exact: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """States after one edit: (id, node, rest, times, plus, skip). skip: how many of the next code points the edit used up.

    A word meets all edges of a node on its path: by its own it leaves out the next code point, by another it puts
    that one's in, or has it in place of the next. Of edits that give the same word, such as leaving out
    either of two equal neighbours, only the last is made. A state whose next code point cannot follow is not made.
    """
    met = _joined(exact, edges.select("node", "c", "child", "beside", "below"), ["node"], n).withColumns({"now": _next(1), "then": _next(2)})
    own = F.col("c") == F.col("now")
    state = lambda node, skip: F.struct(F.col(node).alias("node"), F.lit(skip).alias("skip"))
    none = F.lit(None).cast("struct<node:bigint,skip:int>")
    first = F.when(own, F.when((F.col("then") != F.col("now")) & _follows(F.col("then"), "beside"), state("node", 1)).otherwise(none)).otherwise(F.when(_follows(F.col("now"), "below"), state("child", 0)).otherwise(none))
    second = F.when(~own & (F.col("rest") != "") & _follows(F.col("then"), "below"), state("child", 1)).otherwise(none)
    made = met.filter(first.isNotNull() | second.isNotNull()).withColumn("made", F.explode(F.array(first, second))).filter("made IS NOT NULL")
    return made.select("id", "made.node", "rest", "times", "plus", "made.skip")


def strides(states: DataFrame) -> DataFrame:
    """(id, node): where states of long words come to their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = pow(BASE, -1, PRIME)
        for batch in batches:
            node, rest, times, plus, skip = (batch.column(c).to_pylist() for c in ("node", "rest", "times", "plus", "skip"))
            ends = []
            for x, r, t, p, s in zip(node, rest, times, plus, skip):
                if s:  # what follows the code point that is skipped
                    t = t * back % PRIME
                    p = (p - t * (ord(r[0]) + 1)) % PRIME
                ends.append((x * t + p) % PRIME)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ends, pa.int64())], ["id", "node"])

    return states.mapInArrow(run, "id long, node long")


def neighbours(words: DataFrame, least_length: int) -> DataFrame:
    """(id, to): every two words that are one edit apart, from both sides. words: as `named` gives them."""
    kept = [edges := edge_table(words, least_length // 2), exact := cut(unedited(words))]
    edited = cut(one_edit(exact, edges, exact.count()))
    kept.append(edited)
    ends = strides(edited.filter("times IS NOT NULL"))
    states = edited.filter("times IS NULL").select("id", "node", F.expr("substring(rest, skip + 1)").alias("rest"))
    while True:
        ends = ends.unionByName(states.filter("rest = ''").select("id", "node"))
        going = states.filter("rest <> ''").withColumn("c", F.substring("rest", 1, 1))
        n = going.count()
        if not n:
            break
        down = _joined(going, edges.select("node", "c", "child", "below"), ["node", "c"], n).filter(_follows(_next(2), "below"))
        states = cut(down.select("id", F.col("child").alias("node"), F.expr("substring(rest, 2)").alias("rest")))
        kept.append(states)
    last = words.select(F.explode(F.array("id", "backwards")).alias("node"), F.col("id").alias("to"))
    found = cut(ends.join(last, "node").select("id", "to").distinct())
    discard(*kept)
    return found


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """(id, root) of rows (id, form): the last form of each chain, by pointer doubling; chains have at most so many hops."""
    up = forms.select("id", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, hops)))):
        further = up.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        up = cut(up.join(further, "root", "left").select("id", F.coalesce("beyond", "root").alias("root")))
    return up


def variants(counts: DataFrame, ratio: int = 5, least_length: int = 6) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a dictionary (word, n) of distinct words of at least least_length code points."""
    if ratio < 2:
        raise ValueError("a form needs at least twice the count, else chains need not end")
    words = cut(named(counts))
    near = neighbours(words, least_length)
    target = words.select(F.col("id").alias("to"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form", "to")).alias("best")
    judged = cut(near.join(target, "to").groupBy("id").agg(F.count("*").alias("n_near"), best))
    most = words.agg(F.max("n")).first()[0] or 1
    fits = F.col("form_n") >= ratio * F.col("n")
    joined = words.join(judged.select("id", "n_near", "best.form", "best.to", (-F.col("best.minus")).alias("form_n")), "id", "left")
    joined = cut(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(fits, F.col(c)).alias(c) for c in ("form", "form_n", "to"))))
    last = roots(joined.filter("to IS NOT NULL").select("id", F.col("to").alias("form")), math.ceil(math.log(most, ratio)) + 1)
    last = last.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = joined.join(last, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their neighbours' number, form and root."""
    return variants(word_counts(table(spark, sf_dir, "documents")))
