"""Token counts by trie-shared dynamic programming over a public vocabulary.

The tokenizer is a unigram model on the pieces of a public SentencePiece file: piece number r (counted from the first
ordinary one) has the score -log(r + 1), Zipf's law, as the file's own scores are ranks. A pre-token is a
white-space-separated word behind the word mark; its segmentation has the best sum of scores and, of equals,
the fewest pieces. A character in no piece counts as its UTF-8 bytes, each at the score of the last piece.

The new distinct pre-tokens of a batch are sorted, which is the preorder of their trie: each step keeps the forward
scores of the prefix shared with the word before and computes only the nodes below it, so each trie node is scored
once. Counts at terminal nodes go into a bounded memory that lasts for the worker's life.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import ship, type_of

MARK = "▁"
CACHE_WORDS = 1_000_000


class Unigram:
    """Piece scores by text, and what an unknown character costs a byte."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.worst = min(scores.values(), default=-1.0)
        self.known: dict[bytes, int] = {}

    @classmethod
    def load(cls, path: str) -> Unigram:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return cls({p: -math.log(r + 1) for r, p in enumerate(pieces, 1)})

    def count_sorted(self, words: list[str]) -> Iterator[int]:
        """Number of tokens of each of the sorted words (mark included), sharing work along their trie."""
        get, longest, worst = self.scores.get, self.longest, self.worst
        best, used, last = [0.0], [0], ""
        for word in words:
            shared = len(commonprefix((last, word)))
            del best[shared + 1 :], used[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode())
                top, least = best[end - 1] + worst * size, used[end - 1] + size
                for start in range(max(0, end - longest), end):
                    score = get(word[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or (score == top and used[start] + 1 < least):
                            top, least = score, used[start] + 1
                best.append(top)
                used.append(least)
            last = word
            yield used[-1]

    def learn(self, words: set[bytes]) -> None:
        texts = sorted((MARK + w.decode(), w) for w in words)
        self.known.update(zip((w for _, w in texts), self.count_sorted([t for t, _ in texts]), strict=True))

    def count(self, texts: list[bytes | None]) -> tuple[list[int], list[int]]:
        """Words and tokens of each UTF-8 text; null counts as empty."""
        split = [(t or b"").split() for t in texts]
        seen = set().union(*split)
        missing = seen.difference(self.known)
        if len(self.known) + len(missing) > CACHE_WORDS:
            self.known.clear()
            missing = seen
        self.learn(missing)
        get = self.known.__getitem__
        return [len(words) for words in split], [sum(map(get, words)) for words in split]


@cache
def _model(path: str) -> Unigram:
    return Unigram.load(path)


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = _model(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            words, tokens = model.count(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))], names=["id", "n_words", "n_tokens"])


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_tokens)`` for every row, from its whole text; null and empty texts count 0.

    Rows come back as often as they came in; other columns are ignored, whatever their names; an empty table gives an
    empty one.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(lambda b: _count_batches(b, model_path), f"id {type_of(df, id_col)}, n_words long, n_tokens long")
