"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Documents become pieces of at most `capacity` tokens. Only how many pieces there are of each length
matters for the packing, so the plan is made on that histogram, at most `capacity` rows whatever the
corpus: bin completion looks at the longest piece left, enumerates the undominated fillings of the room
beside it, and branches over them with multiplicities; a node is pruned when the waste so far cannot
lead to fewer sequences than the best solution known, which starts as best-fit decreasing. Spark then
ranks the pieces of a length and hands each rank its place in the plan.

Defined results: null or empty text is the end token alone. Equal rows, and rows of one or of no doc_id, are packed one by one. No
documents: no rows. Extra columns are ignored. A text's white space may be of any kind.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.llm.common import LOWER, SPACES, WordMemo, byte_of_char, cut, grown, kept_by_worker, parts, table, text_blocks

NAME = "op10_best_fit_packing"

# Classes of bytes: 0 white space, 1 letters (a-z, and those of U+00C0 to U+00FF), 2 punctuation, 3 digits, 4 what can
# belong to either neighbour (the apostrophe, control characters and bytes of all other non-ASCII characters).
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[b for b in range(0x21, 0x7F) if b != 0x27]] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[np.frombuffer(SPACES, np.uint8)] = 0
#: Whether a pre-token always ends between two classes: letters and punctuation part, a digit stands alone.
_PARTS, _SPACES_ONLY = np.zeros(256, np.uint8), np.zeros(256, np.uint8)  # by 5 times the first class and the second
for _at in range(25):
    _SPACES_ONLY[_at] = 0 in divmod(_at, 5)
    _PARTS[_at] = 0 in divmod(_at, 5) or 3 in divmod(_at, 5) or divmod(_at, 5) in ((1, 2), (2, 1))
#: Begins every special token of the vocabulary.
MARKER = b"<|"
#: Bytes of lower-case letters, which alone are one pre-token; the model is given a character for each byte.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
_CHAR = np.arange(256, dtype="<u4")
_CHAR[[b for b in byte_of_char().values() if b != 0x20]] = [ord(c) for c, b in byte_of_char().items() if b != 0x20]


def mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for a table of 256 bytes."""
    return np.frombuffer(bytearray(data.tobytes().translate(table.tobytes())), np.uint8)


def letters_only(words: np.ndarray) -> np.ndarray:
    """Which of the words, given with a space between two, are of lower-case letters only."""
    odd, lead = ~_LETTER[words], words == 0xC3
    second = (words >= 0x80) & ~lead
    odd[1:] |= second[1:] & ~lead[:-1]
    odd[:-1] |= lead[:-1] & ~second[1:]
    odd[0], odd[-1] = odd[0] | second[0], odd[-1] | lead[-1]
    ends = np.flatnonzero(words == 0x20)
    odd[ends] = False
    return np.add.reduceat(odd, np.concatenate(([0], ends)), dtype=np.int64) == 0


def unit_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, parts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each stretch that no class change cuts, and each row's first (with a last entry: all stretches)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut_before = np.ones(len(data) + 1, bool)
    cut_before[1:-1] = mapped(kind[:-1] * 5 + kind[1:], parts_at).view(bool)
    cut_before[offsets] = True
    solid = kind > 0
    starts, ends = np.flatnonzero(cut_before[:-1] & solid), np.flatnonzero(cut_before[1:] & solid) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block of texts with its letters in lower case, and the unit_spans of it.

    A letter before a non-ASCII character of another class stays as it is: that may be a mark, and marks are composed
    with letters before those are lower-cased (h and U+0331 are one character, H and U+0331 are two). A block that may
    hold special tokens is left as it is and cut at white space only.
    """
    kind = mapped(data, _CLASS)
    if MARKER in data.tobytes():
        return data, *unit_spans(data, offsets, kind, _SPACES_ONLY)
    lower = mapped(data, LOWER)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[data[lead + 1] | 0x20 != 0xB7]  # neither of the signs for times and divided by
    kind[lead] = kind[lead + 1] = 1
    lower[lead + 1] |= 0x20 * (data[lead + 1] < 0x9F).astype(np.uint8)
    before = np.flatnonzero((kind[1:] == 4) & (data[1:] >= 0x80))
    lower[before] = data[before]
    return lower, *unit_spans(lower, offsets, kind, _PARTS)


Plan = list[tuple[int, tuple[int, ...]]]  # how many sequences are filled with which lengths


class ChunkTokenizer(WordMemo):
    """Token ids of texts, put together from the ids of short stretches.

    Neither normaliser nor pre-tokeniser of the vocabulary looks across white space, digits, or a change
    between letters and punctuation (but for the apostrophe and non-ASCII characters other than the letters of
    Latin-1, which are never cut off), so a text's ids are its stretches' ids in order; and it lower-cases, so letters
    can be lower-cased first. Stretches of lower-case letters need neither of the two and go to the vocabulary's model
    at once; all others go through the whole tokeniser. The memo keeps the ids of the stretches seen.
    """

    limit = 1_000_000  # their ids are short: some 80 bytes a stretch

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread: its memory stays small
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.zero = self.tokenizer.encode("0", add_special_tokens=False).ids[0]
        super().__init__()

    def forget(self) -> None:
        self.n = self.used = 0
        self.length, self.start, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        letters = letters_only(np.frombuffer(b" ".join(words), np.uint8))
        self.length, self.start = grown(self.length, self.n + len(words)), grown(self.start, self.n + len(words))
        for rows, learnt in ((np.flatnonzero(letters), self._letters), (np.flatnonzero(~letters), self._others)):
            if len(rows):
                ids, lengths = learnt([words[i] for i in rows.tolist()])
                self.ids = grown(self.ids, self.used + len(ids))
                self.length[self.n + rows], self.start[self.n + rows] = lengths, self.used + np.cumsum(lengths) - lengths
                self.ids[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
        self.n += len(words)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case letters, one after the other, and how many each has."""
        tokenize = self.tokenize
        chars = _CHAR[np.frombuffer(b" ".join(words), np.uint8)].tobytes().decode("utf-32-le").split(" ")
        ids: list[int] = []
        ends = [0]
        for word in chars:
            ids += [t.id for t in tokenize(word)]
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(ends)

    def _others(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any stretches."""
        zeros = [b"0" in w for w in words]  # a digit of its own, or anything in a block cut at white space only
        return self._one_by_one(words) if sum(zeros) > 1 else self._around(words, zeros.index(True)) if any(zeros) else self._joined(words)

    def _one_by_one(self, words: list[bytes], at_once: int = 500) -> tuple[np.ndarray, np.ndarray]:
        lists = list(chain.from_iterable(self._ids([w.decode() for w in words[i : i + at_once]]) for i in range(0, len(words), at_once)))
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths

    def _around(self, words: list[bytes], at: int) -> tuple[np.ndarray, np.ndarray]:
        """Joined, but for the one word that holds a 0."""
        sides = [self._joined(words[:at]) if at else None, self._one_by_one(words[at : at + 1]), self._joined(words[at + 1 :]) if at + 1 < len(words) else None]
        ids, lengths = zip(*(x for x in sides if x is not None))
        return np.concatenate(ids), np.concatenate(lengths)

    def _joined(self, words: list[bytes], at_once: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """The same for words without a 0: many words in one text, a 0 after each to tell them apart."""
        texts = ((b" 0 ".join(words[i : i + at_once]) + b" 0").decode() for i in range(0, len(words), at_once))
        ids = np.concatenate([np.array(self._ids([t])[0], np.uint32) for t in texts])
        ends = np.flatnonzero(ids == self.zero)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, each text's followed by end_id, and where each text's begin (with a last entry: all ids)."""
        data, starts, ends, bounds = stretches(data, offsets)
        rows = self.rows(data, starts, ends)
        lengths = self.length[rows]
        before = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.ids[np.repeat(self.start[rows] - before[:-1], lengths) + np.arange(before[-1])]
        stops = before[bounds[1:]]
        return np.insert(ids, stops, np.uint32(end_id)), np.concatenate(([0], stops + np.arange(1, len(stops) + 1)))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of capacity tokens; with_ids adds the ids themselves. Map-only."""
    schema = PIECES + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_by_worker(("tokenizer", tokenizer), lambda: ChunkTokenizer(tokenizer)).encode
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for lo, _, data, offsets in text_blocks(batch.column("text")):
                ids, bounds = encode(data, offsets, end_id)
                ids = ids.astype("<u4", copy=False)
                rows: list[tuple] = []
                for at, (begin, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), lo):
                    for piece, k in enumerate(range(begin, end, capacity)):
                        own = ids[k : min(end, k + capacity)]
                        rows.append((at, piece, k - begin, len(own), zlib.crc32(own), *([own.astype(np.int32)] * with_ids)))
                at, *columns = zip(*rows)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] * with_ids)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids)]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on a histogram: pieces of a length go, many at a time, where they leave least room."""
    rooms: list[int] = []  # sorted, distinct
    groups: dict[int, list[list]] = {}  # room left: [how many sequences, lengths]

    def put(room: int, n: int, lengths: tuple[int, ...]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([n, lengths])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                if left >= fit:
                    put(capacity - fit * length, left // fit, (length,) * fit)
                if left % fit:
                    put(capacity - left % fit * length, 1, (length,) * (left % fit))
                break
            room = rooms[at]
            n, lengths = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            fit = room // length
            take = min(n, left // fit)
            if take:
                put(room - fit * length, take, lengths + (length,) * fit)
                left -= take * fit
            elif left:
                take = 1
                put(room - left * length, 1, lengths + (length,) * left)
                left = 0
            if n > take:
                put(room, n - take, lengths)
    return [(n, lengths) for room in rooms for n, lengths in groups[room]]


def _reach(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each i, as bits of a number, the sums up to room that pieces of lengths[i:] can make."""
    mask, bits = (1 << (room + 1)) - 1, 1
    out = [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        x, n, step = lengths[i], min(counts[lengths[i]], room // lengths[i]), 1
        while n:  # so many times x, in doubling steps
            take = min(step, n)
            bits |= (bits << (x * take)) & mask
            n, step = n - take, 2 * step
        out[i] = bits
    return out


class Steps:
    """What the search may still do: lengths looked at, whether they lead to a filling or not."""

    def __init__(self, left: float):
        self.left = left


def fillings(counts: dict[int, int], room: int, most_waste: int, steps: Steps | None = None) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of a room with the pieces left, least waste first, one at a time: no piece left fits in
    what remains, nor could one of the filling give its place to a longer one. Only sums that can be made are followed.
    None follow once the steps are used up (no steps given: all follow)."""
    steps = steps or Steps(float("inf"))
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    ascending = lengths[::-1]
    reach = _reach(lengths, counts, room)
    steps.left -= len(lengths)
    used: Counter = Counter()
    chosen: list[int] = []

    def free(low: int, high: int) -> bool:
        """Is a piece of a length from low to high left over?"""
        for at in range(bisect_left(ascending, low), bisect_left(ascending, high + 1)):
            steps.left -= 1
            if counts[ascending[at]] > used[ascending[at]]:
                return True
        return False

    def exactly(start: int, left: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield tuple(chosen)
            return
        for i in range(start, len(lengths)):
            steps.left -= 1
            if steps.left < 0 or not reach[i] >> left & 1:
                return  # nor can anything further down
            x = lengths[i]
            if x <= left and counts[x] > used[x] and reach[i] >> (left - x) & 1:
                chosen.append(x)
                used[x] += 1
                yield from exactly(i, left - x)
                used[x] -= 1
                chosen.pop()

    for waste in range(min(most_waste, room) + 1):
        if reach[0] >> (room - waste) & 1:
            for filling in exactly(0, room - waste):
                if not free(1, waste) and not any(free(x + 1, x + waste) for x in set(chosen)):
                    yield waste, filling


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by the sum of the lengths, and by the pieces of which no two fit together."""
    total = sum(length * n for length, n in histogram.items())
    return max(-(-total // capacity), sum(n for length, n in histogram.items() if 2 * length > capacity))


#: The search's steps, and those for each distinct length: a few seconds at most, whatever the lengths.
STEPS, STEPS_A_LENGTH = 2_000_000, 4_000
#: Levels of the search, the deepest, whose fillings are at hand; those of others are found again when it comes back to them.
OPEN_LEVELS = 64


def bin_completion(histogram: dict[int, int], capacity: int, nodes: int | None = -1) -> Plan:
    """As few sequences as the search finds within so many nodes and steps; never more than best-fit decreasing.

    The bound: sequences so far and what is left over the capacity. The waste that a better solution
    may have in all is therefore fixed, and a branch that wastes more is cut off. nodes: by default 3000 and 4 for
    each distinct length; steps (lengths looked at on the way to a filling, found or not): STEPS and STEPS_A_LENGTH for
    each distinct length. None searches to the end, a sequence at a time, so what it gives is the least (for small
    histograms: the search is exponential). The search stops as soon as the lower bound is met.
    """
    counts = {length: n for length, n in histogram.items() if n > 0}
    total = sum(length * n for length, n in counts.items())
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_n = sum(n for n, _ in best)
    one_by_one = nodes is None
    budget = float("inf") if nodes is None else 3000 + 4 * len(counts) if nodes < 0 else nodes
    steps = Steps(float("inf") if nodes is None else STEPS + STEPS_A_LENGTH * len(counts))

    # depth-first, by hand: each frame holds how many fillings were tried, what to undo, and the fillings to come
    plan: Plan = []
    waste = 0

    def beside(longest: int, passed: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Fillings beside the longest piece left, but for the first ones."""
        left = {**counts, longest: counts[longest] - 1}
        return islice(fillings(left, capacity - longest, (best_n - 1) * capacity - total - waste, steps), passed, None)

    def take(n: int, lengths: tuple[int, ...], sign: int) -> None:
        for length, k in Counter(lengths).items():
            counts[length] = counts.get(length, 0) - sign * n * k
            if not counts[length]:
                del counts[length]

    frames: list[list] = [[0, None, None]] if counts and best_n > least else []
    while frames and budget > 0 and steps.left > 0 and best_n > least:
        frame = frames[-1]
        if frame[1] is not None:  # back from below: undo
            n, lengths, lost = frame[1]
            plan.pop()
            waste -= lost
            take(n, lengths, -1)
            frame[1] = None
        longest = max(counts)
        if frame[2] is None:
            frame[2] = beside(longest, frame[0])
            if len(frames) > OPEN_LEVELS:
                frames[-1 - OPEN_LEVELS][2] = None
        left, filling = next(frame[2], (None, ()))
        frame[0] += 1
        allowed = (best_n - 1) * capacity - total - waste
        if left is None or left > allowed:  # least waste first: what follows wastes no less
            frames.pop()
            continue
        budget -= 1
        lengths = (longest, *filling)
        n = min(counts[x] // k for x, k in Counter(lengths).items())
        n = min(n, allowed // left) if left else n
        n = min(n, 1) if one_by_one else n
        if n <= 0:
            continue
        take(n, lengths, 1)
        plan.append((n, lengths))
        waste += n * left
        frame[1] = (n, lengths, n * left)
        if counts:
            frames.append([0, None, None])
        else:
            best, best_n = list(plan), sum(k for k, _ in plan)
    return best


def slots(plan: Plan) -> np.ndarray:
    """Places by length and rank: rows (length, first rank, sequence of the first rank, pieces of the length a sequence, offset of the first)."""
    rows, ranks, sequence = [], Counter(), 0
    for n, lengths in plan:
        offset = 0
        for length, k in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, ranks[length], sequence, k, offset))
            ranks[length] += n * k
            offset += k * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, plan: Plan) -> DataFrame:
    """Give every piece (with its rank among its length) a sequence and an offset."""
    spark = pieces.sparkSession
    shipped = spark.sparkContext.broadcast(slots(plan))  # bounded by the capacity, not by the corpus
    kept = [c for c in pieces.columns if c != "rank"]
    schema = pieces.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shipped.value
        keys = (where[:, 0] << 44) + where[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = where[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            past = rank - row[:, 1]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 2] + past // row[:, 3]), pa.array(row[:, 4] + past % row[:, 3] * length)], [*kept, "sequence_id", "offset"])

    return pieces.mapInArrow(run, schema)


def ranked(pieces: DataFrame) -> DataFrame:
    """Rank of each piece among those of its length, from 0; counted in salted groups, so a common length is no single task."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * parts(pieces))))
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("_own", F.row_number().over(own)).join(sizes, ["length", "_salt"]).select(*pieces.columns, (F.col("_own") - 1 + F.col("_before")).alias("rank"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, nodes: int | None = -1) -> DataFrame:
    """Tokenise, cut and pack all documents: one row per piece with its sequence and offset.

    The pieces' digests are written once to the shared folder, since both the histogram and the ranks read them.
    """
    pieces = cut(pieces_of(docs, tokenizer, capacity, end_id))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    return place(ranked(pieces), bin_completion(histogram, capacity, nodes))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
