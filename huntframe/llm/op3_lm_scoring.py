"""LM scoring with a log-bilinear model, trained by noise-contrastive estimation on the whole corpus.

Tokens are words and an end of text. The model predicts a token's class from the three tokens before it: the
commonest words are classes of their own, all others share classes by their last two bytes, and a word
within a shared class has its add-one share of the class. Score of class w after h1 h2 h3 (nearest first):
(r_h1 C1 + r_h2 C2 + r_h3 C3) . q_w + b_w, with a matrix for each position.

Training reads every training token: each task goes on from the model of the round before, over the part of
its texts that the round takes, in batches with noise samples from a seeded generator; the models are then
averaged by tokens, in a tree. Rounds part the texts between them, so a token is seen once in all (a task
with few tokens goes over them again). Scoring normalises exactly: batched matrix products over all classes
give each context's normaliser, once for a context while a task remembers it.

A word's corpus count is needed too. The words above a count that at most `head_words` words reach go to
the workers as arrays. Every other word gives one row (row, word, n) with how often its text has it; those
meet their counts in a join that deals hot words (unseen in training, frequent elsewhere) to several tasks.
Words are known by 64-bit hashes.

Defined results: one row per input row, whatever its doc_id (repeated or null; a null doc_id is scored but not
learnt from). Null or empty text is its end alone. No training documents: N and all counts are 0 and
the score is the uniform one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.llm.common import LOWER, SPACES, HashIndex, class_table, cut, discard, grown, join_dealt, kept_by_worker, mix, row_sums, span_hashes, table, text_blocks, word_spans

NAME = "op3_lm_scoring"
_IS_WORD = class_table(SPACES)
SHARED = 255  # classes of words by their last two bytes


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shared class of each word of a block, and where each row's words begin."""
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets, _IS_WORD)
    hashes = span_hashes(data, starts, ends)
    last = data[ends - 1].astype(np.uint64)
    previous = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    shared = (mix(last * np.uint64(256) + previous) % np.uint64(SHARED)).astype(np.int64)
    return hashes, shared, bounds


def word_counts(texts: DataFrame, hold: int = 1 << 20) -> DataFrame:
    """(word, shared, c) over all words; a task adds up what it holds before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            hashes, shared, counts = (np.concatenate(x) for x in zip(*held))
            word, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(shared[at].astype(np.int16)), pa.array(np.bincount(inverse, counts).astype(np.int64))], ["word", "shared", "c"])

        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column("text")):
                hashes, shared, _ = _words(data, offsets)
                word, at, counts = np.unique(hashes, return_index=True, return_counts=True)
                held.append((word, shared[at], counts))
                size += len(word)
                if size > hold:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return texts.select("text").mapInArrow(run, "word long, shared short, c long").groupBy("word", "shared").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Counts of the head words, which of them are classes of their own, and the sums of the shared classes."""

    words: np.ndarray  # hashes
    counts: np.ndarray
    own: np.ndarray  # class of a head word, or -1 where it shares one
    n_own: int
    shared_total: np.ndarray  # per shared class: tokens + distinct words + 1
    total: int  # N, ends and all
    distinct: int  # V
    documents: int

    @property
    def end(self) -> int:
        return self.n_own + SHARED

    def index(self) -> HashIndex:
        index = HashIndex()
        index.add(self.words)
        return index


def lexicon(counts: DataFrame, documents: int, own_words: int, head_words: int) -> tuple[Lexicon, DataFrame]:
    """The lexicon, and the (word, c) of all words outside its head."""
    octave = F.floor(F.log2("c") * 16)
    sizes = counts.groupBy(octave.alias("o")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("o")).collect()  # 16 rows a doubling of the count
    room, least = head_words, None
    for row in sizes:
        room -= row["n"]
        if room < 0:
            break
        least = row["o"]
    inside = (octave >= least) if least is not None else F.lit(False)
    head = counts.filter(inside).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words, c = (head.column(x).to_numpy() for x in ("word", "c"))
    n_own = min(own_words, len(words))
    own = np.full(len(words), -1, np.int64)
    own[:n_own] = np.arange(n_own)
    shared = np.ones(SHARED)
    for row in counts.groupBy("shared").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        shared[row["shared"]] += row["c"] + row["n"]
    of = head.column("shared").to_numpy()[:n_own]
    np.subtract.at(shared, of, c[:n_own] + 1)
    n, v = sum(r["c"] for r in sizes), sum(r["n"] for r in sizes)
    found = Lexicon(words.view(np.uint64), c, own, n_own, shared, n + documents, v + bool(documents), documents)
    return found, counts.filter(~inside).select("word", "c")


def _classes(hashes: np.ndarray, shared: np.ndarray, own: HashIndex, n_own: int) -> np.ndarray:
    at = own.find(hashes)
    return np.where(at >= 0, at, n_own + shared)


CONTEXT = 3  # tokens before


def with_contexts(hashes: np.ndarray, shared: np.ndarray, bounds: np.ndarray, own: HashIndex, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the tokens before (nearest first) and of every token of a block, each row's end after its words; before a text stand ends."""
    after = np.insert(_classes(hashes, shared, own, n - 1 - SHARED), bounds[1:], n - 1)
    starts = bounds[:-1] + np.arange(len(bounds) - 1)
    place = np.arange(len(after)) - np.repeat(starts, np.diff(bounds) + 1)
    before = np.full((len(after), CONTEXT), n - 1, np.int64)
    for i in range(CONTEXT):
        at = np.flatnonzero(place > i)
        before[at, i] = after[at - 1 - i]
    return before, after


@dataclass
class LogBilinear:
    context: np.ndarray  # r
    turns: np.ndarray  # C, one for each position
    target: np.ndarray  # q
    bias: np.ndarray

    def predicted(self) -> np.ndarray:
        """r C for each position and class."""
        return np.stack([self.context @ turn for turn in self.turns])

    def normalisers(self, hidden: np.ndarray, rows: int = 256) -> np.ndarray:
        """log of the sum over all classes for each predicted vector, in batches of matrix products."""
        out = np.empty(len(hidden), np.float32)
        reach = float(np.sqrt((hidden * hidden).sum(1)).max() * np.sqrt((self.target * self.target).sum(1)).max()) if len(hidden) else 0.0
        shift = reach + float(self.bias.max())  # no score lies above it, and the largest of a row no more than twice reach below
        target, bias = np.ascontiguousarray(self.target.T), (self.bias - np.float32(shift)).astype(np.float32)
        for lo in range(0, len(out), rows):
            scores = hidden[lo : lo + rows] @ target
            scores += bias
            if reach < 40:
                np.exp(scores, out=scores)
                out[lo : lo + rows] = shift + np.log(scores.sum(1))
            else:
                top = scores.max(1, keepdims=True)
                out[lo : lo + rows] = shift + top[:, 0] + np.log(np.exp(scores - top).sum(1))
        return out

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.turns, self.target, self.bias]

    def to_bytes(self) -> bytes:
        return np.concatenate([a.ravel() for a in self.arrays()]).astype(np.float32).tobytes()

    def from_vector(self, vector: np.ndarray) -> LogBilinear:
        """A model of this one's shapes."""
        parts_, at = [], 0
        for a in self.arrays():
            parts_.append(vector[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return LogBilinear(*parts_)


def first_model(unigram: np.ndarray, dim: int, seed: int) -> LogBilinear:
    """Small random vectors; the bias alone gives the classes' own shares."""
    rng = np.random.default_rng(seed)
    n = len(unigram)
    vectors = lambda: rng.normal(0, 0.1, (n, dim)).astype(np.float32)
    return LogBilinear(vectors(), np.stack([np.eye(dim, dtype=np.float32) / (1 + i) for i in range(CONTEXT)]), vectors(), np.log(unigram).astype(np.float32))


def _sums(classes: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of values by class."""
    dim = values.shape[1]
    return np.bincount((classes[:, None] * dim + np.arange(dim)).ravel(), values.ravel(), n * dim).reshape(n, dim)


class Trainer:
    """Noise-contrastive estimation in batches, by Adagrad: a token against `noise` samples of the unigram, which a batch shares."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, noise: int = 48, rate: float = 0.08, seed: int = 7):
        self.weights = [a.copy() for a in model.arrays()]
        self.squares = [np.full_like(a, 1e-3) for a in self.weights]
        self.noise, self.rate, self.rng = noise, rate, np.random.default_rng(seed)
        self.cumulated = np.cumsum(unigram / unigram.sum())
        self.log_noise = np.log(noise * unigram / unigram.sum()).astype(np.float32)

    def step(self, before: np.ndarray, after: np.ndarray) -> None:
        r, c, q, b = self.weights
        drawn = np.minimum(np.searchsorted(self.cumulated, self.rng.random(self.noise)), len(b) - 1)
        seen = [r[before[:, i]] for i in range(CONTEXT)]
        hidden = sum(x @ c[i] for i, x in enumerate(seen))
        wanted, other = q[after], q[drawn]
        up = 1 / (1 + np.exp(np.clip((hidden * wanted).sum(1) + b[after] - self.log_noise[after], -30, 30)))
        down = -1 / (1 + np.exp(np.clip(self.log_noise[drawn] - b[drawn] - hidden @ other.T, -30, 30)))
        to_hidden = up[:, None] * wanted + down @ other
        n, rows = len(b), len(after)
        grad_q = _sums(np.concatenate((after, drawn)), np.concatenate((up[:, None] * hidden, down.T @ hidden)), n)
        grad_b = np.bincount(after, up, n) + np.bincount(drawn, down.sum(0), n)
        grad_c = np.stack([x.T @ to_hidden for x in seen])
        grad_r = _sums(before.T.ravel(), np.concatenate([to_hidden @ turn.T for turn in c]), n)
        for w, g, s in zip(self.weights, (grad_r, grad_c, grad_q, grad_b), self.squares):
            g = (g / rows).astype(np.float32)
            s += g * g
            w += self.rate * g / np.sqrt(s)

    def model(self) -> LogBilinear:
        return LogBilinear(*self.weights)


def train_round(texts: DataFrame, lex: Lexicon, model: LogBilinear, unigram: np.ndarray, batch: int = 1024, least_steps: int = 800, noise: int = 48, rate: float = 0.25, seed: int = 7) -> LogBilinear:
    """The tasks' models after going over their texts, averaged by tokens."""
    n = lex.end + 1
    shipped = texts.sparkSession.sparkContext.broadcast((lex.words[: lex.n_own], model, unigram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start, shares = shipped.value
        own = HashIndex()
        own.add(words)
        trainer = Trainer(start, shares, noise, rate, seed)
        tokens = steps = size = 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        first: list[tuple[np.ndarray, np.ndarray]] = []  # the batches of a task that has few

        def steps_over(before: np.ndarray, after: np.ndarray) -> int:
            order = np.random.default_rng(seed + steps).permutation(len(after))  # a batch is of many texts
            before, after = before[order], after[order]
            for lo in range(0, len(after), batch):
                now = before[lo : lo + batch], after[lo : lo + batch]
                trainer.step(*now)
                if len(first) < least_steps:
                    first.append(now)
            return -(-len(after) // batch)

        for arrow in batches:
            for _, _, data, offsets in text_blocks(arrow.column("text")):
                held.append(with_contexts(*_words(data, offsets), own, n))
                size += len(held[-1][1])
                if size >= 64 * batch:
                    tokens += size
                    steps += steps_over(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            tokens += size
            steps += steps_over(*map(np.concatenate, zip(*held)))
        for again in range(min(least_steps - steps, 20 * steps) if tokens else 0):
            trainer.step(*first[again % len(first)])
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([trainer.model().to_bytes()], pa.binary())], ["tokens", "weights"])

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = rows["tokens"].to_numpy()
        total = sum(n_ * np.frombuffer(w, np.float32).astype(np.float64) for n_, w in zip(tokens, rows["weights"]))
        return pd.DataFrame({"tokens": [int(tokens.sum())], "weights": [(total / tokens.sum()).astype(np.float32).tobytes()]})

    schema = "tokens long, weights binary"
    models = cut(texts.select("text").mapInArrow(run, schema))
    while (many := models.count()) > 16:  # a tree: no task and not the driver holds more than some models
        before, models = models, cut(models.withColumn("g", F.pmod(F.xxhash64("weights"), F.lit(-(-many // 12)))).groupBy("g").applyInPandas(mean, schema))
        discard(before)
    last = models.toPandas()
    discard(models)
    return model.from_vector(np.frombuffer(mean(last)["weights"][0], np.float32)) if len(last) else model


def class_shares(lex: Lexicon) -> np.ndarray:
    """Unigram share of each class: own words, shared classes, the end."""
    counts = np.concatenate((lex.counts[: lex.n_own], lex.shared_total - 1, [lex.documents])) + 0.5
    return counts / counts.sum()


def train(texts: DataFrame, lex: Lexicon, dim: int = 24, rounds: int = 2, seed: int = 7, **options) -> LogBilinear:
    """A model of all the texts: rounds over parts of them, dealt by hash of the text."""
    unigram = class_shares(lex)
    model = first_model(unigram, dim, seed)
    for at in range(rounds):
        now = texts.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == at) if rounds > 1 else texts
        model = train_round(now, lex, model, unigram, seed=seed + at, **options)
    return model


PARTIAL = "row long, doc_id long, word long, n long, n_tokens long, n_known long, base double, score double"


class Normalisers:
    """log normalisers of the contexts seen so far, forgotten and begun anew at `limit`."""

    def __init__(self, model: LogBilinear, limit: int = 1 << 20):
        self.model, self.limit, self.predicted = model, limit, model.predicted()
        self.index, self.values = HashIndex(), np.zeros(1024, np.float32)

    def scores(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """log10 P(class | classes before), normalised over all classes."""
        n = len(self.model.bias)
        key = np.zeros(len(after), np.uint64)
        hidden = np.zeros((len(after), self.predicted.shape[2]), np.float32)
        for i in range(CONTEXT):
            key = key * np.uint64(n) + before[:, i].astype(np.uint64)
            hidden += self.predicted[i][before[:, i]]
        key = mix(key + np.uint64(1))
        if self.index.n > self.limit:
            self.index, self.values = HashIndex(), np.zeros(1024, np.float32)
        at = self.index.find(key)
        new = np.flatnonzero(at < 0)
        if len(new):
            distinct, first = np.unique(key[new], return_index=True)
            n_before = self.index.n
            self.index.add(distinct)
            self.values = grown(self.values, self.index.n)
            self.values[n_before : self.index.n] = self.model.normalisers(hidden[new[first]])
            at[new] = self.index.find(key[new])
        plain = (hidden * self.model.target[after]).sum(1) + self.model.bias[after]
        return ((plain - self.values[at]) / np.log(10)).astype(np.float64)


def score_texts(docs: DataFrame, lex: Lexicon, rest: DataFrame, model: LogBilinear) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of docs.

    A text gives one row with all that the head words tell, and a row for each distinct rare word in it; rare words
    then meet their counts by a join on the word, and sums by row end it.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((lex, model))
    digest = hashlib.md5(lex.words[:1000].tobytes() + model.to_bytes()).hexdigest()
    smooth = float(np.log10(lex.total + lex.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def build() -> tuple:
            lexicon_, model_ = shipped.value
            own = HashIndex()
            own.add(lexicon_.words[: lexicon_.n_own])
            return lexicon_, lexicon_.index(), own, Normalisers(model_), np.log10(lexicon_.counts + 1.0), -np.log10(lexicon_.shared_total)

        lex_, index, own, normal, logs, shares = kept_by_worker(("lm", digest), build)
        n = lex_.end + 1
        end_log, end_known = np.log10(lex_.documents + 1.0), int(lex_.documents > 0)
        for batch in batches:
            rows, doc_ids = batch.column("row").to_numpy(), batch.column("doc_id")
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                hashes, shared, bounds = _words(data, offsets)
                at = index.find(hashes)
                head = at >= 0
                log = np.where(head, logs[np.maximum(at, 0)], 0.0) if len(logs) else np.zeros(len(at))
                classes = np.where(at >= 0, lex_.own[np.maximum(at, 0)], -1) if len(logs) else at
                in_class = np.where(classes >= 0, 0.0, log + shares[shared])  # within a shared class; a rare word's count comes later
                before, after = with_contexts(hashes, shared, bounds, own, n)
                tokens = np.diff(bounds) + 1
                token_bounds = np.concatenate(([0], np.cumsum(tokens)))
                n_known = row_sums(head.astype(np.int64), bounds) + end_known
                base = row_sums(log, bounds) + end_log - tokens * smooth
                score = row_sums(normal.scores(before, after), token_bounds) + row_sums(in_class, bounds)
                rare = np.flatnonzero(~head)
                of = np.repeat(np.arange(lo, hi), np.diff(bounds))[rare]
                order = np.lexsort((hashes[rare], of))
                of, word = of[order], hashes[rare][order]
                fresh = np.ones(len(of), bool)
                fresh[1:] = (of[1:] != of[:-1]) | (word[1:] != word[:-1])
                firsts = np.flatnonzero(fresh)
                counts = np.diff(np.append(firsts, len(of)))
                place = np.concatenate((np.arange(lo, hi), of[firsts]))
                m, k = hi - lo, len(firsts)
                zeros, none = np.zeros(k), np.zeros(k, np.int64)
                words = pa.array(np.concatenate((np.zeros(m, np.int64), word[firsts].view(np.int64))), mask=np.concatenate((np.ones(m, bool), np.zeros(k, bool))))
                numbers = ((np.zeros(m, np.int64), counts), (tokens, none), (n_known, none), (base, zeros), (score, zeros))
                yield pa.RecordBatch.from_arrays([pa.array(rows[place]), doc_ids.take(pa.array(place)), words, *(pa.array(np.concatenate(x)) for x in numbers)], [c.split()[0] for c in PARTIAL.split(", ")])

    partial = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, PARTIAL))
    known = join_dealt(partial.filter("word IS NOT NULL"), rest.select("word", "c"), "word", "row", how="left").withColumn("c", F.coalesce("c", F.lit(0)))
    late = F.col("n") * F.log10(F.col("c") + 1.0)
    rare = known.select("row", "doc_id", "n_tokens", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"), late.alias("base"), late.alias("score"))
    whole = partial.filter("word IS NULL").select("row", "doc_id", "n_tokens", "n_known", "base", "score")
    sums = [F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score")]
    return whole.unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *sums).drop("row")


def lm_scores(docs: DataFrame, learn_from, own_words: int = 512, head_words: int = 1 << 20, **training) -> DataFrame:
    """Score all documents with a model of those that the condition learn_from picks; adds train_tokens."""
    texts = docs.filter(learn_from).select("text")
    counts = cut(word_counts(texts))
    lex, rest = lexicon(counts, texts.count(), own_words, head_words)
    model = train(texts, lex, **training)
    return score_texts(docs, lex, rest, model).withColumn("train_tokens", F.lit(lex.total).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from six of seven folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = lm_scores(docs, F.coalesce(~held_out, F.lit(False)))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
