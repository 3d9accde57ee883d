"""Token counts under a unigram piece model, with forward scores shared along a trie of pre-tokens.

Pre-tokens are the words between ASCII white space, marked at the front as the piece vocabulary marks
them. The distinct pre-tokens that a batch brings anew go into a trie. A node's forward score (the best
log-probability of any piece sequence that spells its prefix, and how many pieces that takes) depends on
the prefix alone, so it is computed once, whichever words share it; terminal nodes hold the words' counts.

Piece probabilities are not trained, as tokenizers are not here: they follow from the vocabulary's rank order by the Zipf-Mandelbrot
rule 1 / (rank + 2.7). A byte that no piece covers is a fallback piece of a probability below all others.

Defined results: null or empty text has no words, no tokens and score 0. Equal texts have equal counts;
ties between piece sequences of one score go to fewer pieces. One row per input row, whatever its doc_id
(repeated or null). No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from huntframe.llm.common import SPACES, WordMemo, class_table, grown, kept_by_worker, row_sums, table, text_blocks, word_spans

NAME = "op1_token_counts"
WORD_MARK = "▁".encode()
_IS_WORD = class_table(SPACES)
#: How far down the trie a node's score is kept for the words that share it; deeper, a word goes on alone, so that one of megabytes takes no more memory.
SHARED_BYTES = 512
#: Text whose new pre-tokens share one trie.
TRIE_BYTES = 2 << 20


def load_pieces(path: str) -> dict[bytes, float]:
    """log10 probability of every ordinary piece of a SentencePiece file, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = [model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    weights = 1.0 / (np.arange(len(ranked)) + 2.7)
    return dict(zip(ranked, np.log10(weights / weights.sum()).tolist()))


class PieceCounter(WordMemo):
    """Piece counts of pre-tokens, with a bounded memo across batches."""

    def __init__(self, pieces: dict[bytes, float], mark: bytes = WORD_MARK):
        self.mark = mark
        #: below every piece, so a byte stands alone only where no piece covers it better
        self.fallback = min(pieces.values(), default=0.0) - 1.0
        #: a node of the pieces' own trie: the nodes below by byte, and the score of the piece that ends here
        self.root: list = [{}, None]
        for piece, score in pieces.items():
            node = self.root
            for byte in piece:
                node = node[0].setdefault(byte, [{}, None])
            node[1] = score
        super().__init__()

    def forget(self) -> None:
        self.n, self.tokens, self.scores = 0, np.zeros(1024, np.int32), np.zeros(1024)

    def _start(self) -> tuple[float, int, list]:
        return 0.0, 0, [(0.0, 0, self.root)]

    def _step(self, state: tuple[float, int, list], byte: int) -> tuple[float, int, list]:
        """The trie node below: forward score, pieces, and the pieces still open with the score before each."""
        score, count, active = state
        best, pieces, going = score + self.fallback, count + 1, []
        for before, n, (below, _) in active:
            node = below.get(byte)
            if node is not None:
                going.append((before, n, node))
                end = node[1]
                if end is not None:
                    end += before
                    if end > best or end == best and n < pieces:
                        best, pieces = end, n + 1
        going.append((best, pieces, self.root))
        return best, pieces, going

    def learn(self, words: list[bytes]) -> None:
        """Put distinct, sorted pre-tokens in a trie, walked depth first, and store the terminal nodes."""
        path = [self._start()]
        for byte in self.mark:
            path.append(self._step(path[-1], byte))
        base, last, ends = len(path), b"", []
        for word in words:
            shared = 0
            for a, b in zip(word, last[:SHARED_BYTES]):
                if a != b:
                    break
                shared += 1
            del path[base + shared :]
            for byte in word[shared:SHARED_BYTES]:
                path.append(self._step(path[-1], byte))
            state = path[-1]
            for byte in word[SHARED_BYTES:]:  # a state holds the pieces that are open, no more
                state = self._step(state, byte)
            last = word
            ends.append(state[:2])
        self.tokens, self.scores = grown(self.tokens, self.n + len(words)), grown(self.scores, self.n + len(words))
        self.scores[self.n : self.n + len(words)], self.tokens[self.n : self.n + len(words)] = zip(*ends)
        self.n += len(words)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, tokens and log10 score of each text of a block."""
        starts, ends, bounds = word_spans(data, offsets, _IS_WORD)
        rows = self.rows(data, starts, ends)
        return np.diff(bounds), row_sums(self.tokens[rows], bounds), row_sums(self.scores[rows], bounds)


SCHEMA = "doc_id long, n_words long, n_tokens long, score double"


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Words, tokens and log10 probability of every text. Map-only; a task holds one block of text and a bounded memo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_by_worker(("pieces", vocabulary), lambda: PieceCounter(load_pieces(vocabulary)))
        for batch in batches:
            blocks = [counter.count(data, offsets) for _, _, data, offsets in text_blocks(batch.column("text"), TRIE_BYTES)]
            columns = [np.concatenate(x) for x in zip(*blocks)] or [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64())))], ["doc_id", "n_words", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the public 32k piece vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
