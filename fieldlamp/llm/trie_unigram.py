"""Token counts of a unigram tokenizer by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens (words with the word mark before them) of a piece of texts form a trie. Level by level, a
node's best score is the best, over the pieces that end there, of the score of the node where the piece began plus the
piece's; it is computed once for all pre-tokens that share the prefix. The count at a pre-token's last node is
its number of tokens, and a document's count is the sum over its words. Ties of scores go to fewer tokens. A character
that no piece covers costs one token a byte.

The vocabulary is a public one and is not trained here: its pieces in their order, with Zipf log-probabilities of
their ranks. Nothing is shuffled, tries live for one piece of about 8 MB, words of more than LONG characters are
scored one by one. Defined results: a null or blank text has 0 tokens; rows are independent, so repeated rows and ids
give repeated results; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, mix64, small_batches, tokenizer_path, words_of_batch

MARK = "▁"
LONG = 64
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
FILTER_BITS = 22


class Unigram:
    """Pieces with log-probabilities, found by the hash of a substring."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.byte_score = min(pieces.values()) - 10.0
        keys = np.array([self.hash(x) for x in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], np.array(list(pieces.values()))[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.slot(self.keys)] = True
        self.powers = np.array([pow(int(BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)

    @classmethod
    def from_sentencepiece(cls, path: str) -> Unigram:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(path))
        normal = [i for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        return cls({p.id_to_piece(i): -math.log(k + 2.7) for k, i in enumerate(normal)})

    @staticmethod
    def hash(x: str) -> int:
        h = 0
        for c in x:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (mix64(h) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and those pieces' scores."""
        maybe = np.flatnonzero(self.filter[self.slot(h)])
        at = np.searchsorted(self.keys, h[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == h[maybe]
        return maybe[hit], self.scores[at[hit]]

    def count(self, word: str) -> int:
        """The tokens of one pre-token, by the same recurrence."""
        n = len(word)
        best, tokens = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for i in range(1, n + 1):
            size = len(word[i - 1].encode("utf-8", "replace"))
            s, t = best[i - 1] + size * self.byte_score, tokens[i - 1] + size
            for k in range(1, min(i, self.longest) + 1):
                p = self.pieces.get(word[i - k : i])
                if p is not None:
                    a, b = best[i - k] + p, tokens[i - k] + 1
                    if a > s or a == s and b < t:
                        s, t = a, b
            best[i], tokens[i] = s, t
        return tokens[n]

    def counts(self, words: list[str]) -> np.ndarray:
        """The tokens of distinct pre-tokens, by a trie."""
        out = np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(size > LONG):
            out[i] = self.count(words[i])
        live = np.flatnonzero((size <= LONG) & (size > 0))
        if not len(live):
            return out
        live = live[np.argsort(-size[live], kind="stable")]  # at each depth the live ones are a prefix
        sizes = size[live]
        chars = np.frombuffer("".join(words[i] for i in live).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        node = np.zeros(len(live), np.int64)  # of each word, at the depth before
        levels = [(np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.uint64))]  # score, tokens, prefix hash of a depth's nodes
        ancestors: list[np.ndarray] = []  # of the last depth's nodes, nearest first
        for depth in range(1, int(sizes[0]) + 1):
            n = int(np.searchsorted(-sizes, -depth, side="right"))
            key = node[:n] << 21 | chars[starts[:n] + depth - 1]
            unique, node = np.unique(key, return_inverse=True)
            parent, char = unique >> 21, unique & 0x1FFFFF
            ancestors = [parent, *(a[parent] for a in ancestors[: self.longest - 1])]
            with np.errstate(over="ignore"):
                prefix = levels[-1][2][parent] * BASE + char.astype(np.uint64) + np.uint64(1)
            units = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
            score, tokens = levels[-1][0][parent] + units * self.byte_score, levels[-1][1][parent] + units
            for k, a in enumerate(ancestors, 1):
                s0, t0, h0 = levels[-k]
                with np.errstate(over="ignore"):
                    hit, p = self.look_up(prefix - h0[a] * self.powers[k])
                s, t = s0[a[hit]] + p, t0[a[hit]] + 1
                better = (s > score[hit]) | ((s == score[hit]) & (t < tokens[hit]))
                hit = hit[better]
                score[hit], tokens[hit] = s[better], t[better]
            levels = [*levels[-self.longest :], (score, tokens, prefix)]
            ends = sizes[:n] == depth
            out[live[:n][ends]] = tokens[node[ends]]
        return out


def count_tokens(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row."""

    def run(batches):
        unigram = Unigram.from_sentencepiece(model)
        for piece in small_batches(batches, "text"):
            begin, words = words_of_batch(piece.column("text"))
            each = unigram.counts([MARK + w for w in words.dictionary.to_pylist()])
            upto = np.concatenate([[0], np.cumsum(each[words.indices.to_numpy()])]) if len(words) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(begin), pa.int64()), pa.array(np.diff(upto[begin]), pa.int64())], ["doc_id", "n_words", "n_tokens"])

    bounded(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
