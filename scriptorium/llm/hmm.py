"""Language-model scoring with a hidden Markov model over words.

Symbols are the most frequent words, and classes (by a hash of their ending) of all others,
inside which a word has its smoothed share of the class. Baum-Welch trains the states: each
task runs the forward-backward recursion over the documents it reads and yields expected
counts, which are summed over the corpus and become the next model. A text's score is its
exact likelihood by the scaled forward recursion.

Texts are cut into chunks that advance together. A chunk's transfer matrix (from each state
at its start to each at its end) is computed first; the matrices then hand the state
probabilities on from chunk to chunk, so cutting changes nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lexicon, Shared, count_words, materialise, most_frequent, pieces_of, text_bytes, unsigned

#: The token that ends each text; no word holds a blank.
END = b" "
STATES, TOP_WORDS, CLASSES = 4, 8192, 256
#: Passes of Baum-Welch, each over the whole texts of all training documents.
PASSES = 14
#: Words in the workers' table, and those of them that are found without hashing.
TABLE_WORDS, FREQUENT_WORDS = 6_000_000, 60_000
#: Tokens in a chunk, steps between scalings, and documents that advance together.
CHUNK, SCALE, DOCS = 64, 16, 512
#: Tokens by which a state's emissions lean on the words' overall shares.
PRIOR, SEED = 200.0, 11


class Chunks:
    """Symbols of several texts, cut: symbols[t, c], longest chunks first."""

    def __init__(self, texts: list[np.ndarray]):
        counts = np.array([max(1, -(-len(x) // CHUNK)) for x in texts], np.int64)
        self.texts, self.first = len(texts), np.cumsum(counts) - counts
        self.counts = counts
        length = np.full(counts.sum(), CHUNK, np.int64)
        length[self.first + counts - 1] = [len(x) - (c - 1) * CHUNK for x, c in zip(texts, counts.tolist(), strict=True)]
        flat = np.zeros(len(length) * CHUNK, np.int64)
        flat[np.repeat(np.arange(len(length)) * CHUNK, length) + np.concatenate([np.arange(k) for k in length]) if len(length) else []] = np.concatenate(texts) if texts else []
        self.order = np.argsort(-length, kind="stable")
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(self.order))
        self.symbols = np.ascontiguousarray(flat.reshape(-1, CHUNK)[self.order].T)
        self.active = np.searchsorted(-length[self.order], -np.arange(CHUNK), "left")


class Hmm:
    """start[s], move[s, s'], emit[s, symbol]: a text begins in start, moves, then emits, at each token."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def begin(cls, share: np.ndarray, states: int, rng: np.random.Generator) -> Hmm:
        emit = share * rng.uniform(0.5, 1.5, (states, len(share)))
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1) if states > 1 else 0.9)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def transfers(self, c: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """m[i, j, chunk] up to the logarithm in the second."""
        s, n = len(self.start), c.symbols.shape[1]
        m = np.repeat(np.eye(s)[:, :, None], n, 2)
        log, across = np.zeros(n), np.ascontiguousarray(self.move.T)
        for t in range(CHUNK):
            k = int(c.active[t])
            if not k:
                break
            new = np.matmul(across, m[:, :, :k])
            new *= np.take(self.emit, c.symbols[t, :k], axis=1)
            m[:, :, :k] = new
            if t % SCALE == SCALE - 1 or t == CHUNK - 1:
                total = m.sum((0, 1))
                m /= total
                log += np.log(total)
        total = m.sum((0, 1))
        m /= total
        return m, log + np.log(total)

    def forward(self, c: Chunks, m: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State probabilities before each chunk, and each text's log-likelihood."""
        before = np.empty((len(self.start), m.shape[2]))
        now, out = np.repeat(self.start[:, None], c.texts, 1), np.zeros(c.texts)
        for r in range(int(c.counts.max()) if c.texts else 0):
            on = np.flatnonzero(c.counts > r)
            at = c.place[c.first[on] + r]
            before[:, at] = now[:, on]
            new = np.einsum("in,ijn->jn", now[:, on], m[:, :, at])
            total = new.sum(0)
            now[:, on] = new / total
            out[on] += np.log(total) + log[at]
        return before, out

    def likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of each text's probability."""
        c = Chunks(texts)
        m, log = self.transfers(c)
        return self.forward(c, m, log)[1]

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions of the texts under this model."""
        c = Chunks(texts)
        m, log = self.transfers(c)
        before, _ = self.forward(c, m, log)
        s, n = len(self.start), c.symbols.shape[1]
        after = np.ones((s, n))
        beta = np.ones((s, c.texts))
        for r in range(int(c.counts.max()) - 1 if c.texts else -1, -1, -1):
            on = np.flatnonzero(c.counts > r)
            at = c.place[c.first[on] + r]
            after[:, at] = beta[:, on]
            new = np.einsum("ijn,jn->in", m[:, :, at], beta[:, on])
            beta[:, on] = new / new.sum(0)
        start = self.start[:, None] * beta
        start = (start / start.sum(0)).sum(1)
        alpha, now, across = np.empty((CHUNK, s, n)), before, np.ascontiguousarray(self.move.T)
        for t in range(CHUNK):
            alpha[t] = now
            k = int(c.active[t])
            if k:
                now = now.copy()
                new = (across @ now[:, :k]) * np.take(self.emit, c.symbols[t, :k], axis=1)
                now[:, :k] = new / new.sum(0)
        move, posterior, beta = np.zeros((s, s)), np.zeros((CHUNK, s, n)), after
        for t in range(CHUNK - 1, -1, -1):
            k = int(c.active[t])
            if not k:
                continue
            w = np.take(self.emit, c.symbols[t, :k], axis=1) * beta[:, :k]
            back = self.move @ w
            a = alpha[t][:, :k] / (alpha[t][:, :k] * back).sum(0)
            move += self.move * (a @ w.T)
            posterior[t, :, :k] = (across @ a) * w
            beta = beta.copy()
            beta[:, :k] = back / back.sum(0)
        flat = c.symbols.ravel()
        emit = np.stack([np.bincount(flat, posterior[:, i].ravel(), self.emit.shape[1]) for i in range(s)])
        return start, move, emit

    def updated(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Hmm:
        """The maximum, leaning a little on uniform starts and moves and on the overall shares."""
        start, move, emit = start + 1, move + 1, emit + PRIOR * share
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


class Vocabulary:
    """What workers need of the training counts."""

    def __init__(self, lexicon: Lexicon, counts: np.ndarray, symbols: np.ndarray, top: list[bytes], mass: np.ndarray, total: int, distinct: int):
        self.lexicon, self.counts, self.symbols, self.top = lexicon, np.append(counts, 0), np.append(symbols, -1).astype(np.int32), {w: i for i, w in enumerate(top)}
        self.mass, self.total, self.distinct = mass, total, distinct

    def symbol(self, word: bytes) -> int:
        i = self.top.get(word)
        return len(self.top) + word_class(word) if i is None else i


def vocabulary(counts: DataFrame, table_words: int) -> tuple[Vocabulary, np.ndarray]:
    """Of (word, n): the workers' tables, and the share of each symbol."""
    sums = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    best = counts.orderBy(F.desc("n"), "word").limit(min(FREQUENT_WORDS, table_words)).collect()
    top = [bytes(r.word) for r in best[:TOP_WORDS]]
    spark = counts.sparkSession
    place = spark.createDataFrame([(w, i) for i, w in enumerate(top)], "word binary, place int")
    kind = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(CLASSES))
    classes = counts.join(F.broadcast(place), "word", "left_anti").groupBy(kind.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes:
        n[r.k], v[r.k] = r.n, r.v
    share = np.concatenate([[r.n for r in best[:TOP_WORDS]], n]) + 1.0
    table = counts if sums.v <= table_words else most_frequent(counts, table_words)
    got = table.join(F.broadcast(place), "word", "left").select(F.xxhash64("word").alias("h"), "n", F.coalesce("place", kind + len(top)).cast("int").alias("symbol")).toArrow()
    lexicon = Lexicon(unsigned(got["h"].to_numpy()), [bytes(r.word) for r in best])
    return Vocabulary(lexicon, got["n"].to_numpy().astype(np.int64), got["symbol"].to_numpy(), top, n + v + 1, sums.n, sums.v), share / share.sum()


def encoded(bodies: DataFrame, held, complete: bool) -> DataFrame:
    """(id, row, learn, n_tokens, n_known, base, inside, symbols, other) of each document.

    inside: log10 of the words' shares in their classes; other: words to be looked up elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc: Vocabulary = held.value
        for batch in batches:
            for part in pieces_of(batch, 1):
                words: list[bytes] = []
                sizes = []
                for body in part.column(1).to_pylist():
                    w = body.lower().split() if body else []
                    words += w
                    words.append(END)
                    sizes.append(len(w) + 1)
                rows = voc.lexicon.find(words)
                symbols = voc.symbols[rows]
                for k in np.flatnonzero(rows < 0).tolist():
                    symbols[k] = voc.symbol(words[k])
                here = np.ones(len(words), bool) if complete else rows >= 0
                c = voc.counts[rows]
                base = np.where(here, np.log10((c + 1) / (voc.total + voc.distinct + 1)), 0.0)
                rare = symbols >= len(voc.top)
                inside = np.where(here & rare, np.log10((c + 1) / voc.mass[np.where(rare, symbols - len(voc.top), 0)]), 0.0)
                ends = np.cumsum(sizes)
                bounds = np.concatenate([[0], ends])
                sums = [np.add.reduceat(x, bounds[:-1]) if len(x) else np.empty(0) for x in (base, inside, (here & (c > 0)).astype(np.int64))]
                other: list[list[bytes]] = [[] for _ in sizes]
                for k in np.flatnonzero(~here).tolist():
                    other[int(np.searchsorted(ends, k, "right"))].append(words[k])
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(sums[2], pa.int64()), pa.array(sums[0], pa.float64()), pa.array(sums[1], pa.float64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(symbols)), pa.array(other, pa.list_(pa.binary()))],
                    ["id", "learn", "n_tokens", "n_known", "base", "inside", "symbols", "other"],
                )

    rows = bodies.mapInArrow(run, "id bigint, learn boolean, n_tokens bigint, n_known bigint, base double, inside double, symbols array<int>, other array<binary>")
    return rows.withColumn("row", F.monotonically_increasing_id())


def _texts(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy()
    at = at - at[0]
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def train(learning: DataFrame, share: np.ndarray, *, states: int, passes: int) -> Hmm:
    """Baum-Welch over (symbols) from random emissions: each pass sums the expected counts of all documents."""
    spark, rng = learning.sparkSession, np.random.default_rng(SEED)
    hmm = Hmm.begin(share, states, rng)
    size = len(share)
    for _ in range(passes):
        held = Shared(spark, hmm)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model, total = held.value, None
            for batch in batches:
                every = _texts(batch.column(0))
                for i in range(0, len(every), DOCS):
                    part = np.concatenate([x.ravel() for x in model.expected(every[i : i + DOCS])])
                    total = part if total is None else total + part
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.float64())], ["at", "n"])

        counts = learning.select("symbols").mapInArrow(run, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
        total = np.zeros(states + states * states + states * size)
        for r in counts:
            total[r.at] = r.n
        start, move, emit = np.split(total, [states, states + states * states])
        hmm = hmm.updated(start, move.reshape(states, states), emit.reshape(states, size), share)
    return hmm


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, states: int = STATES, passes: int = PASSES, table_words: int = TABLE_WORDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document row.

    Learns from the rows outside the held-out fold, where crc32 of the id as text leaves
    `held` of `folds`. Null, empty and wordless texts are the end alone. base_score is the
    add-one unigram's log10 probability, score the HMM's. Rows that repeat an id count and
    are scored each by itself. With no training rows every state emits alike. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    out = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    bodies = text_bytes(docs, id_col, text_col).withColumn("learn", ~out)
    counts = materialise(count_words(bodies.filter("learn"), lambda b: b.lower().split(), extra=END), "words")
    voc, share = vocabulary(counts, table_words)
    complete = voc.distinct <= table_words
    tables = Shared(spark, voc)
    rows = materialise(encoded(bodies, tables, complete), "symbols")
    model = Shared(spark, train(rows.filter("learn"), share, states=states, passes=passes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = model.value
        for batch in batches:
            every = _texts(batch.column(5))
            log = np.concatenate([np.empty(0), *(hmm.likelihood(every[i : i + DOCS]) for i in range(0, len(every), DOCS))])
            value = log / np.log(10) + batch.column(4).to_numpy()
            yield pa.record_batch([*(batch.column(k) for k in range(4)), pa.array(value, pa.float64()), batch.column(6)], ["id", "row", "n_tokens", "n_known", "score", "base"])

    scored = rows.select("id", "row", "n_tokens", "n_known", "inside", "symbols", "base").mapInArrow(run, "id bigint, row bigint, n_tokens bigint, n_known bigint, score double, base double")
    if not complete:
        kind = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(CLASSES))
        mass = F.element_at(F.array(*(F.lit(float(x)) for x in voc.mass)), kind.cast("int") + 1)
        rest = rows.select("row", F.explode("other").alias("word")).join(counts, "word", "left")
        rest = rest.select("row", F.coalesce("n", F.lit(0)).alias("c"), mass.alias("mass"))
        more = rest.groupBy("row").agg(F.sum((F.col("c") > 0).cast("bigint")).alias("known"), F.sum(F.log10((F.col("c") + 1) / float(voc.total + voc.distinct + 1))).alias("b"), F.sum(F.log10((F.col("c") + 1) / F.col("mass"))).alias("i"))
        scored = scored.join(more, "row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("known", F.lit(0)), "base": F.col("base") + F.coalesce("b", F.lit(0.0)), "score": F.col("score") + F.coalesce("i", F.lit(0.0))})
    return scored.select("id", out.alias("held_out"), "n_tokens", "n_known", F.lit(int(voc.total)).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")
