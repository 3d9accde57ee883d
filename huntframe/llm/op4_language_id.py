"""Language ID by cross-parsing: how few phrases of a language's text cover a document.

For each language a suffix automaton of labelled text gives longest-match lengths. A word, with the
spaces around it, is cut greedily into the longest stretches that the language's text contains; a
character it never saw is a phrase of its own. Phrases are normalised by the code length of a pointer
into that language's words and by the document's letters; the language that needs fewest bits wins.

A phrase ends with its word, so that a word's phrases are worked out once a task however often it
stands in the corpus. No match then reaches beyond a word of the labelled text either, and the automaton
of its distinct words, each between two spaces, gives the same lengths as that of the text itself.

The automata are fitted on a bounded sample of the labelled rows: sample_docs whole texts a language,
those of lowest md5 of doc_id, of at most most_languages languages (more raise an error: none is left
out). Every document is judged on its whole text.

Defined results: null text or text without a letter is `und` with score 0. Ties go to the language
first by code point. No labelled rows at all: every document is `und`. A labelled row with a null doc_id
is not learnt from. Rows are judged one by one, so repeated rows agree; extra columns are ignored
(identify) or kept (keep_identified).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.llm.common import LOWER, WordMemo, class_table, grown, kept_by_worker, row_sums, table, text_blocks, word_spans

NAME = "op4_language_id"
UNDETERMINED = "und"

#: Runs of letters (and of the few letter-like numerals that Python's \w holds).
_LETTERS = re.compile(r"[^\W\d_]+")
#: Where a text can be cut without looking at its characters: ASCII that is no letter. Letters are told apart within the chunks.
_IS_CHUNK = class_table(bytes(b for b in range(128) if not 0x61 <= b <= 0x7A))


class CharAutomaton:
    """Generalised suffix automaton of a language's words, each between two spaces; arcs in sorted arrays."""

    def __init__(self, words: list[str]):
        arcs, link, length = [{}], [-1], [0]

        def split(parent: int, c: int, to: int) -> int:
            """The state for parent's longest stretch and c, split off `to` where that is longer."""
            if length[to] == length[parent] + 1:
                return to
            clone = len(length)
            arcs.append(dict(arcs[to]))
            length.append(length[parent] + 1)
            link.append(link[to])
            link[to] = clone
            while parent >= 0 and arcs[parent].get(c) == to:
                arcs[parent][c] = clone
                parent = link[parent]
            return clone

        for word in words:
            last = 0
            for c in map(ord, f" {word} "):
                to = arcs[last].get(c)
                if to is not None:
                    last = split(last, c, to)
                    continue
                new, parent = len(length), last
                arcs.append({})
                length.append(length[last] + 1)
                link.append(0)
                while parent >= 0 and c not in arcs[parent]:
                    arcs[parent][c] = new
                    parent = link[parent]
                if parent >= 0:
                    link[new] = split(parent, c, arcs[parent][c])
                last = new
        n = sum(map(len, arcs))
        key = np.fromiter((s << 21 | c for s, out in enumerate(arcs) for c in out), np.int64, n)
        to = np.fromiter((x for out in arcs for x in out.values()), np.int32, n)
        order = np.argsort(key)
        self.key, self.to = key[order], to[order]

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states that the characters lead to, or -1."""
        key = state.astype(np.int64) << 21 | c
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.to[at], -1)

    def phrases(self, words: list[str]) -> np.ndarray:
        """Phrases of each word's greedy parse, a phrase being the longest stretch from its start that the words contain. All words go forward together, a character at a time; the few that are long go on alone."""
        if not len(self.key) or not words:
            return np.array([len(w) for w in words], np.int64)
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin, size = (np.concatenate(([0], np.cumsum(lengths)[:-1])))[order], lengths[order]
        state, count = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        active, at = len(words), 0
        while active > 0 and at < size[0]:
            active = int(np.searchsorted(-size, -at, "left"))  # words longer than at
            if active < 16 and at > 64:
                break
            c = points[begin[:active] + at]
            to = self._step(state[:active], c)
            stuck = np.flatnonzero(to < 0)
            if len(stuck):
                open_ = state[stuck] > 0
                count[stuck] += 1  # the phrase so far ends, or the character itself was never seen
                again = np.zeros(len(stuck), np.int32)
                fresh = self._step(np.zeros(len(stuck), np.int32), c[stuck])
                again[open_] = np.maximum(fresh[open_], 0)
                count[stuck] += open_ & (fresh < 0)
                to[stuck] = again
            state[:active] = to
            at += 1
        if active > 0 and at < size[0]:
            arcs = dict(zip(self.key.tolist(), self.to.tolist()))
            for i in range(int(np.searchsorted(-size, -at, "left"))):
                now, n = int(state[i]), int(count[i])
                for c in points[begin[i] + at : begin[i] + size[i]].tolist():
                    to_ = arcs.get(now << 21 | c)
                    if to_ is None:
                        n += 1
                        if now:
                            to_ = arcs.get(c)
                            n += to_ is None
                        to_ = to_ or 0
                    now = to_
                state[i], count[i] = now, n
        out = np.empty(len(words), np.int64)
        out[order] = count + (state > 0)
        return out


class Languages:
    """The automata by language, and the code length of a pointer into each."""

    def __init__(self, words: dict[str, list[str]]):
        self.names = sorted(words)
        self.automata = [CharAutomaton(sorted(words[x])) for x in self.names]
        self.bits = np.array([math.log2(2 + sum(len(w) + 1 for w in words[x])) for x in self.names])
        self.digest = hashlib.md5(repr([(x, sorted(words[x])) for x in self.names]).encode("utf-8", "surrogatepass")).hexdigest()


class CrossParser(WordMemo):
    """The languages' automata and the phrases of the chunks parsed so far."""

    def __init__(self, learnt: Languages):
        self.languages, self.automata, self.bits = learnt.names, learnt.automata, learnt.bits
        super().__init__()

    def forget(self) -> None:
        #: by chunk: phrases in each language, characters of its words with one space each, words with a letter
        self.n, self.table = 0, np.zeros((1024, len(self.languages) + 2), np.int32)

    def learn(self, words: list[bytes]) -> None:
        own = [_LETTERS.findall(w.decode().lower()) for w in words]
        distinct = sorted({w for ws in own for w in ws})
        padded = [f" {w} " for w in distinct]
        phrases = np.array([*(a.phrases(padded) for a in self.automata), [len(w) + 1 for w in distinct], [any(map(str.isalpha, w)) for w in distinct]], np.int32).T
        at = dict(zip(distinct, range(len(distinct))))
        bounds = np.concatenate(([0], np.cumsum([len(ws) for ws in own])))
        self.table = grown(self.table, self.n + len(words))
        self.table[self.n : self.n + len(words)] = row_sums(phrases[[at[w] for ws in own for w in ws]], bounds) if distinct else 0
        self.n += len(words)

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For each text of a block the language, the score (how far the best lies below the second, 0 to 1) and its phrases a character (NaN for `und`)."""
        data = LOWER[data]
        starts, ends, bounds = word_spans(data, offsets, _IS_CHUNK)
        rows = self.rows(data, starts, ends)  # may enlarge the table
        totals = row_sums(self.table[rows], bounds)
        if not self.languages:
            return [UNDETERMINED] * len(totals), np.zeros(len(totals)), np.full(len(totals), np.nan)
        known = totals[:, -1] > 0
        bits = totals[:, :-2] * self.bits / np.maximum(totals[:, -2:-1], 1)
        best = np.argmin(bits, axis=1)
        lowest = np.sort(bits, axis=1)
        score = 1.0 - lowest[:, 0] / np.maximum(lowest[:, 1], 1e-9) if len(self.languages) > 1 else np.ones(len(bits))
        names = [self.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())]
        return names, np.where(known, np.clip(score, 0.0, 1.0), 0.0), np.where(known, lowest[:, 0] / self.bits[best], np.nan)


def learn(labelled: DataFrame, sample_docs: int = 320, most_languages: int = 256) -> Languages:
    """The automata of each language's distinct words in the whole texts of sample_docs of its documents, or of all it has.

    Which documents: lowest md5 of doc_id, by a share of each language first, so no group is sorted or gathered whole.
    """
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} labelled languages: raise most_languages, whose automata must fit a worker")
    if not counts:
        return Languages({})
    draw = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    of = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("lang")]
    enough = sample_docs + 5 * math.sqrt(sample_docs) + 20  # that fewer are drawn than wanted does not happen
    share = {lang: enough / n for lang, n in counts.items()}
    drawn: dict[str, list[float]] = {}
    for row in labelled.select("lang", draw.alias("draw")).filter(F.col("draw") < of(share)).collect():
        drawn.setdefault(row["lang"], []).append(row["draw"])
    last = {lang: sorted(draws)[:sample_docs][-1] for lang, draws in drawn.items()}
    picked = labelled.filter(draw <= of(last)).select("lang", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                found = sorted(set(_LETTERS.findall(text.as_py().lower())))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string())], ["lang", "word"])

    distinct = picked.mapInArrow(words, "lang string, word string").distinct().toArrow()  # of sample_docs texts a language
    found: dict[str, list[str]] = {lang: [] for lang in last}
    for lang, word in zip(distinct.column("lang").to_pylist(), distinct.column("word").to_pylist()):
        found[lang].append(word)
    return Languages(found)


def _parser(shipped, digest: str) -> CrossParser:
    return kept_by_worker(("languages", digest), lambda: CrossParser(shipped.value))


def identify(docs: DataFrame, learnt: Languages) -> DataFrame:
    """doc_id, lang_pred, score and phrases (phrases a character, null for `und`) of every document. Map-only."""
    shipped, digest = docs.sparkSession.sparkContext.broadcast(learnt), learnt.digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shipped, digest)
        for batch in batches:
            judged = [parser.judge(data, offsets) for _, _, data, offsets in text_blocks(batch.column("text"))]
            names = pa.array([n for x in judged for n in x[0]], pa.string())
            score, phrases = (np.concatenate([x[i] for x in judged] or [np.zeros(0)]) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names, pa.array(score), pa.array(phrases, mask=np.isnan(phrases))], ["doc_id", "lang_pred", "score", "phrases"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, phrases double")


def keep_identified(docs: DataFrame, learnt: Languages, most_phrases: float = 0.95) -> DataFrame:
    """The documents in one of the learnt languages, all columns as they are.

    Rejected are `und` and texts of which no language's text holds stretches: with most_phrases a character
    nearly every character is a phrase of its own, as in a script that was never seen. Prose needs a third.
    """
    shipped, digest = docs.sparkSession.sparkContext.broadcast(learnt), learnt.digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shipped, digest)
        for batch in batches:
            phrases = [parser.judge(data, offsets)[2] for _, _, data, offsets in text_blocks(batch.column("text"))]
            if phrases:
                yield batch.filter(pa.array(np.concatenate(phrases) <= most_phrases))  # NaN is never kept

    return docs.mapInArrow(run, docs.schema)


def is_held_out(folds: int, fold: int) -> F.Column:
    """Whether crc32 of doc_id as text falls in the held-out fold."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learnt = learn(docs.filter(~F.coalesce(is_held_out(4, 2), F.lit(True))))
    return identify(docs, learnt).select("doc_id", F.coalesce(is_held_out(4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score", "phrases")
