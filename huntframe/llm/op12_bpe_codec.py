"""Byte-pair encoding and decoding, exact, by dynamic programming over the prefixes of each pre-token.

The encoding of every prefix of a pre-token has one last token, whatever follows. It is the one token that ends
the prefix and goes with the last token of the prefix before it: two tokens go together if no merge across their
border comes before the merges that make them. A generalised suffix automaton of the vocabulary, fed with the
pre-token, gives the tokens that end each prefix, longest first; the first that goes with what stands before it is
stored, and back-pointers from the end give the ids.

The normaliser and the pre-tokeniser of the vocabulary file are asked about a stretch of text when a task meets it
first; stretches, their ids and their tokens' texts are kept in a bounded memo. Text decodes to the tokens' strings
with a space between two, as the file names no decoder.

Defined results: null or empty text has no ids and decodes to the empty text. The strings of special tokens in a text
are those tokens. One row per input row, whatever its doc_id (repeated or null). No rows: no rows. Extra columns are
ignored. Ids that the vocabulary lacks decode to nothing; a null list of ids decodes to null.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from huntframe.llm.common import WordMemo, byte_of_char, kept_by_worker, table, text_blocks
from huntframe.llm.op10_best_fit_packing import stretches

NAME = "op12_bpe_codec"
END = "</w>"
#: Symbols: a byte inside a pre-token, or 256 more at its end.
SYMBOLS = 512
NEVER = 1 << 40
#: Pairs of tokens whose test is remembered.
PAIRS = 1_000_000


class VocabularyAutomaton:
    """Generalised suffix automaton of the tokens' symbols, with the tokens that end each matched stretch."""

    def __init__(self, tokens: list[tuple[int, ...]], ids: list[int]):
        """tokens: each one's symbols; ids: their names."""
        self.arc: dict[int, int] = {}  # state * SYMBOLS + symbol: next state
        self.link, self.length = [-1], [0]
        out: list[list[int]] = [[]]
        own: dict[int, list[int]] = {}
        for token, symbols in enumerate(tokens):
            state = 0
            for c in symbols:
                state = self._extend(state, c, out)
            own.setdefault(state, []).append(token)
        # a clone takes over the shorter stretches of a state, and the tokens among them
        self.own: dict[int, list[tuple[int, int]]] = {}
        for state, found in own.items():
            for token in found:
                n, at = len(tokens[token]), state
                while self.length[self.link[at]] >= n:
                    at = self.link[at]
                self.own.setdefault(at, []).append((n, ids[token]))
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {}

    def _extend(self, last: int, c: int, out: list[list[int]]) -> int:
        arc, link, length = self.arc, self.link, self.length
        to = arc.get(last * SYMBOLS + c)
        if to is not None:
            return self._split(last, c, to, out)
        new, parent = len(length), last
        length.append(length[last] + 1)
        link.append(0)
        out.append([])
        while parent >= 0 and parent * SYMBOLS + c not in arc:
            arc[parent * SYMBOLS + c] = new
            out[parent].append(c)
            parent = link[parent]
        if parent >= 0:
            link[new] = self._split(parent, c, arc[parent * SYMBOLS + c], out)
        return new

    def _split(self, parent: int, c: int, to: int, out: list[list[int]]) -> int:
        """The state for parent's longest stretch and c: `to`, or a clone split off it."""
        arc, link, length = self.arc, self.link, self.length
        if length[to] == length[parent] + 1:
            return to
        clone = len(length)
        length.append(length[parent] + 1)
        link.append(link[to])
        link[to] = clone
        out.append(list(out[to]))
        for x in out[to]:
            arc[clone * SYMBOLS + x] = arc[to * SYMBOLS + x]
        while parent >= 0 and arc.get(parent * SYMBOLS + c) == to:
            arc[parent * SYMBOLS + c] = clone
            parent = link[parent]
        return clone

    def ending(self, state: int) -> tuple[tuple[int, int], ...]:
        """(length, token) of the tokens that end the state's stretches, longest first."""
        found = self.ends.get(state)
        if found is None:
            found, at = [], state
            while at > 0:
                found += sorted(self.own.get(at, ()), reverse=True)
                at = self.link[at]
            found = self.ends[state] = tuple(found)
        return found


class Bpe:
    """Encodes pre-tokens of a byte-level BPE vocabulary with word ends, and decodes ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        told = {k: model.get(k) for k in ("type", "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")}
        if told != {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "byte_fallback": False, "ignore_merges": False} or whole["decoder"] is not None:
            raise ValueError(f"not a byte-level BPE vocabulary with word ends and without a decoder: {told}")
        tokenizer = Tokenizer.from_file(path)
        self.normalise, self.pre_tokenise = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}

        self.byte = byte = byte_of_char()

        def symbols(s: str) -> tuple[int, ...]:
            end = s.endswith(END)
            out = [byte[c] for c in (s[: -len(END)] if end else s)]
            return (*out[:-1], out[-1] + 256) if end else tuple(out)

        vocab = model["vocab"]
        n = max(vocab.values()) + 1
        self.rank = [-1] * n  # when a token is made; symbols are there from the beginning
        self.first, self.last = [-1] * n, [-1] * n  # the parts it is made of
        self.pair: dict[int, int] = {}  # two parts' ids as one number: when they are merged
        for rank, merge in enumerate(model["merges"]):
            x, y = merge.split(" ") if isinstance(merge, str) else merge
            left, right, made = vocab[x], vocab[y], vocab[x + y]
            if self.rank[made] >= 0 or max(self.rank[left], self.rank[right]) >= rank:
                raise ValueError("merges that make a token twice, or use one before it is made")
            self.pair[left << 32 | right] = rank
            self.rank[made], self.first[made], self.last[made] = rank, left, right
        self.compatible: dict[int, bool] = {}
        #: tokens that their own merges really make; others never come out
        sound = {i for s, i in vocab.items() if len(symbols(s)) == 1}
        for made in sorted((i for i in range(n) if self.rank[i] >= 0), key=self.rank.__getitem__):
            left, right = self.first[made], self.last[made]
            if left in sound and right in sound and self._apart_before(left, right, self.rank[made]):
                sound.add(made)
        usable = sorted(sound)
        self.automaton = VocabularyAutomaton([symbols(self.strings[i]) for i in usable], usable)

    def _apart_before(self, left: int, right: int, time: int) -> bool:
        """Whether two tokens that stand side by side are made without a merge across their border before a time.

        Back in time from there: beside the border stand two parts, and of the two the one that was made later is
        undone next. Parts that are there together merge if their merge comes before either goes into a larger part; of
        two equal merges the left one is first.
        """
        rank, pair = self.rank, self.pair
        until_left = until_right = time
        while True:
            met = pair.get(left << 32 | right, NEVER)
            if met < until_left and met <= until_right and met < time:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                until_left, left = a, self.last[left]
            else:
                until_right, right = b, self.first[right]

    def encode_words(self, words: Iterable[str]) -> Iterator[list[int]]:
        """Ids of pre-tokens, as their byte-level characters. A word goes on from the prefix that it shares with the one before it."""
        byte, arc, link, length, ending, compatible = self.byte, self.automaton.arc, self.automaton.link, self.automaton.length, self.automaton.ending, self.compatible
        last, size, states = [-1], [0], [(0, 0)]  # of every prefix: its last token, how many symbols that has, and the longest stretch of a token that ends there
        before: list[int] = []
        for word in words:
            symbols = [byte[c] for c in word]
            symbols[-1] += 256
            at = 0
            for x, y in zip(symbols, before):
                if x != y:
                    break
                at += 1
            del last[at + 1 :], size[at + 1 :], states[at + 1 :]
            state, matched = states[at]
            for c in symbols[at:]:
                at += 1
                to = arc.get(state * SYMBOLS + c)
                while to is None:
                    if not state:
                        raise ValueError(f"no token ends with symbol {c}")
                    state = link[state]
                    matched = length[state]
                    to = arc.get(state * SYMBOLS + c)
                state, matched = to, matched + 1
                states.append((state, matched))
                for n, token in ending(state):
                    if n <= matched:
                        if n < at:
                            key = last[at - n] << 32 | token
                            fits = compatible.get(key)
                            if fits is None:
                                if len(compatible) > PAIRS:
                                    compatible.clear()
                                fits = compatible[key] = self._apart_before(last[at - n], token, NEVER)
                            if not fits:
                                continue
                        last.append(token)
                        size.append(n)
                        break
            before = symbols
            ids = []
            while at:
                ids.append(last[at])
                at -= size[at]
            yield ids[::-1]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens' strings are those tokens."""
        pieces = self.special_at.split(text) if self.special_at is not None and "<|" in text else [text]
        ids: list[int] = []
        for piece in pieces:
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                for own in self.encode_words(word for word, _ in self.pre_tokenise(self.normalise(piece))):
                    ids += own
        return ids

    def encode_stretches(self, stretches: list[bytes]) -> list[list[int]]:
        """Ids of sorted stretches of text. Letters from a to z are one pre-token as they are; anything else is for the file's own rules."""
        words = [w.decode() for w in stretches if w.isalpha() and w.islower()]
        plain = self.encode_words(words)
        return [next(plain) if w.isalpha() and w.islower() else self.encode(w.decode()) for w in stretches]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with a space between two."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


class StretchCodec(WordMemo):
    """Ids and token strings of stretches of text that no pre-token crosses, in a bounded memo."""

    def __init__(self, path: str):
        self.bpe = Bpe(path)
        super().__init__()

    def forget(self) -> None:
        self.ids: list[list[int]] = []

    def learn(self, words: list[bytes]) -> None:
        self.ids += self.bpe.encode_stretches(words)

    def stretches(self, data, offsets):
        """Row in the memo of each stretch of a block of texts, and where each text's begin (with a last entry: all)."""
        data, starts, ends, bounds = stretches(data, offsets)
        return self.rows(data, starts, ends).tolist(), bounds.tolist()


class DigestCodec(StretchCodec):
    """The same with the decimal ids and the strings of each stretch ready to be joined, a space before each."""

    def forget(self) -> None:
        super().forget()
        self.decimal: list[bytes] = []
        self.strings: list[bytes] = []

    def learn(self, words: list[bytes]) -> None:
        begin = len(self.ids)
        super().learn(words)
        decode = self.bpe.decode
        for ids in self.ids[begin:]:
            self.decimal.append("".join(f" {i}" for i in ids).encode())
            self.strings.append((" " + decode(ids)).encode() if ids else b"")


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text. Map-only; a task holds one block of text and a bounded memo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_by_worker(("bpe", tokenizer), lambda: StretchCodec(tokenizer))
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                rows, bounds = codec.stretches(data, offsets)
                ids = [[i for r in rows[a:b] for i in codec.ids[r]] for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids). Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_by_worker(("bpe", tokenizer), lambda: StretchCodec(tokenizer))
        for batch in batches:
            texts = [None if ids is None else codec.bpe.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to: (doc_id, n_tokens, ids_sha256, decoded_sha256). Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_by_worker(("bpe digests", tokenizer), lambda: DigestCodec(tokenizer))
        for batch in batches:
            out: list[tuple[int, str, str]] = []
            for _, _, data, offsets in text_blocks(batch.column("text")):
                rows, bounds = codec.stretches(data, offsets)
                for a, b in zip(bounds, bounds[1:]):
                    own = rows[a:b]
                    decimal = b"".join(map(codec.decimal.__getitem__, own))
                    strings = b"".join(map(codec.strings.__getitem__, own))
                    out.append((decimal.count(b" "), hashlib.sha256(decimal[1:]).hexdigest(), hashlib.sha256(strings[1:]).hexdigest()))
            n, ids, texts = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document under the public word vocabulary, and of what they decode to."""
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
