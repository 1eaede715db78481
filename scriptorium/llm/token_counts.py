"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Pre-tokens in sorted order are the trie's paths: what a word shares with the one before is
a stack of prefixes whose forward states stand already, so each shared prefix is computed
once. A state holds the last piece, the score and the number of pieces up to it. For
unigram models it is the best forward score; for BPE models, whose scores are ranks, it is
the one last piece that fits the state before (two pieces fit if merging their letters
gives just these two), which is what BPE makes of the prefix. Counts at the ends of words
are stored by word and summed over documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lexicon, Shared, count_words, materialise, most_frequent, pieces_of, small_batches, unsigned
from .sentencepiece import BPE, FREQUENT_WORDS, UNKNOWN_PENALTY, Model, _splitter

#: Words in the workers' table.
TABLE_WORDS = 4_000_000
#: Pairs of pieces that a worker remembers at most.
KEPT_PAIRS = 2_000_000


class Trie:
    """Forward states along the path of the last word."""

    def __init__(self, model: Model):
        self.model, self.word = model, ""
        self.states: list[tuple[int, int, float]] = [(-1, 0, 0.0)]
        self.fits: dict[tuple[int, int], bool] = {}
        self.spelt = {i: p for p, i in model.pieces.items()}
        self.low = min(model.score) - UNKNOWN_PENALTY
        self.visited = 0

    def count(self, word: str) -> int:
        """The pieces of a word; words must come in sorted order to share their prefixes."""
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        del self.states[shared + 1 :]
        self.word = word
        step = self._merge_step if self.model.kind == BPE else self._score_step
        for end in range(shared + 1, len(word) + 1):
            self.states.append(step(word, end))
            self.visited += 1
        return self.states[-1][1]

    def _unknown(self, word: str, end: int) -> tuple[int, int, float]:
        _, n, score = self.states[end - 1]
        return (-1, n + len(self.model.unknown_ids(word[end - 1])), score + self.low)

    def _score_step(self, word: str, end: int) -> tuple[int, int, float]:
        best, pieces = None, self.model.pieces
        for start in range(max(0, end - self.model.longest), end):
            i = pieces.get(word[start:end])
            if i is not None:
                _, n, score = self.states[start]
                if best is None or score + self.model.score[i] > best[2]:
                    best = (i, n + 1, score + self.model.score[i])
        if pieces.get(word[end - 1]) is None:
            other = self._unknown(word, end)
            best = other if best is None or other[2] > best[2] else best
        return best

    def _merge_step(self, word: str, end: int) -> tuple[int, int, float]:
        pieces, states = self.model.pieces, self.states
        for start in range(max(0, end - self.model.longest), end):
            i = pieces.get(word[start:end])
            if i is not None:
                last, n, _ = states[start]
                if last < 0 or self.fit(last, i):
                    return (i, n + 1, 0.0)
        return self._unknown(word, end)

    def fit(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > KEPT_PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self.model.encode_word(self.spelt[a] + self.spelt[b]) == [a, b]
        return known


def count_pieces(words: DataFrame, model: Model) -> DataFrame:
    """(word, pieces) of distinct words; sorted ranges of them share a trie each."""
    held = Shared(words.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(held.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([trie.count(w) for w in batch.column(0).to_pylist()], pa.int32())], ["word", "pieces"])

    return words.select("word").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(run, "word string, pieces int")


def token_counts(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", table_words: int = TABLE_WORDS) -> DataFrame:
    """(id, n_tokens, n_words) of each document row, whole texts; null and empty texts have none.

    Words' counts go to the workers in a compact table of the `table_words` most frequent;
    where there are more words, documents' other words are looked up by a join with all.
    Rows that repeat an id or a text are counted each by itself, and a word of any length
    whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    split = _splitter(model)
    counts = materialise(count_words(texts, split, "string"), "words")
    pieces = materialise(count_pieces(counts, model).join(counts, "word"), "pieces")
    total = pieces.count()
    top = pieces if total <= table_words else most_frequent(pieces, table_words)
    frequent = [r.word for r in top.orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).collect()]
    got = top.select(F.xxhash64("word").alias("h"), "pieces").toArrow()
    held = Shared(spark, (Lexicon(unsigned(got["h"].to_numpy()), frequent), got["pieces"].to_numpy().astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, values = held.value
        values = np.append(values, 0)  # row -1
        for batch in batches:
            for part in pieces_of(batch, 1):
                words, sizes = [], []
                for t in part.column(1).to_pylist():
                    w = split(t) if t else []
                    words += w
                    sizes.append(len(w))
                rows = lexicon.find(words)
                ends = np.cumsum(sizes)
                totals = np.concatenate([[0], np.cumsum(values[rows])])
                n = totals[ends] - totals[ends - np.array(sizes, np.int64)]
                other: list[list[str]] = [[] for _ in sizes]
                if total > table_words:
                    for k in np.flatnonzero(rows < 0).tolist():
                        other[int(np.searchsorted(ends, k, "right"))].append(words[k])
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(sizes, pa.int64()), pa.array(other, pa.list_(pa.string()))], ["id", "n_tokens", "n_words", "other"])

    found = texts.mapInArrow(run, "id bigint, n_tokens bigint, n_words bigint, other array<string>")
    if total <= table_words:
        return found.select("id", "n_tokens", "n_words")
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "counted")
    rest = found.select("row", F.explode("other").alias("word")).join(pieces.select("word", "pieces"), "word").groupBy("row").agg(F.sum("pieces").alias("more"))
    return found.join(rest, "row", "left").select("id", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"), "n_words")
