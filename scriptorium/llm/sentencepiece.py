"""SentencePiece encoding and decoding through a relational lattice of distinct words.

Distinct words of the corpus are exploded into substrings of bounded length; an equi-join
with the piece table leaves the lattice's edges; these are grouped by word and folded by a
higher-order aggregate. For unigram models the fold is Viterbi: the best score at each
position. A BPE model's scores are ranks of merges, not log-probabilities; the best sum of
them is not what the model encodes. For BPE models the fold therefore runs over the same
edges by rank, from the left: an edge is taken where its two parts stand as they are. It
equals the usual encoding, since a piece's rank is below its parts'; where ranks are equal
(runs of blanks), edges come by their ends, shorter ones first.

The words so encoded go to the workers in a compact table of bounded size, and documents
are encoded where they lie: no document is shuffled. A word beyond the table gets its lattice
and the same fold in the worker that meets it, together with the other such words of a slice
of texts; a word longer than a fold of bits can hold, by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Lexicon, Shared, count_words, materialise, most_frequent, pieces_of, small_batches, spread, unsigned

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Words in the workers' table, and those of them that are found without hashing.
TABLE_WORDS, FREQUENT_WORDS = 500_000, 60_000
#: Code points of the longest word in the lattice; a position is a bit of a BIGINT.
LATTICE_LETTERS = 48
#: Words whose lattices stand in a worker's memory at once, letters of longer words whose ids it remembers, ids that it spells at once.
LATTICE_WORDS, KEPT_LETTERS, SPELT_IDS = 8_000, 1_000_000, 1 << 18
#: What a unigram model takes off the lowest score for an unknown character.
UNKNOWN_PENALTY = 10.0

EDGES = "array<struct<cost:double,end:int,length:int,start:int,id:int>>"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"


class Model:
    """Pieces of a SentencePiece model file."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models with a normalisation of their own are not supported")
        self._set([(p.piece, float(p.score), p.type) for p in m.pieces], m.trainer_spec.model_type, m.normalizer_spec.add_dummy_prefix, m.trainer_spec.byte_fallback)

    @classmethod
    def of(cls, pieces: list[tuple[str, float]], kind: int = UNIGRAM, prefix: bool = True) -> Model:
        """A model from a written-out table; the first piece is the unknown one."""
        self = cls.__new__(cls)
        self._set([(p, s, 2 if i == 0 else 1) for i, (p, s) in enumerate(pieces)], kind, prefix, False)
        return self

    def _set(self, pieces, kind: int, prefix: bool, fallback: bool) -> None:
        self.kind, self.prefix = kind, prefix
        self.score = [s for _, s, _ in pieces]
        self.unknown = next(i for i, (_, _, t) in enumerate(pieces) if t == 2)
        self.pieces = {p: i for i, (p, _, t) in enumerate(pieces) if t in (1, 4)}
        self.longest = max(map(len, self.pieces))
        if self.longest > 255:
            raise ValueError("pieces of more than 255 characters are not supported")
        # pieces of two characters at least by their rank, shifted; what only begins a piece is -1
        rank = {cost: k << 40 for k, cost in enumerate(sorted({-self.score[i] for i in self.pieces.values()}))}
        self.edge = {p[:k]: -1 for p in self.pieces for k in range(2, len(p))}
        self.edge |= {p: rank[-self.score[i]] for p, i in self.pieces.items() if len(p) > 1}
        at = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == 6}
        self.byte = [at[b] for b in range(256)] if fallback else None
        self.spell = [p.replace(SPACE, " ").encode() if t in (1, 4) else bytes([int(p[3:5], 16)]) if t == 6 else b"" if t == 3 else b" \xe2\x81\x87 " for p, _, t in pieces]
        # pieces have blanks in front only, and keep Latin letters and all else apart, so no merge crosses these borders
        latin = re.compile(f"[{LATIN}]")
        mixed = any(len({bool(latin.match(c)) for c in p.lstrip(SPACE)}) > 1 for p in self.pieces)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        if inner:
            raise ValueError("pieces that span words are not supported")
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if mixed else f"{SPACE}*[{LATIN}]+|{SPACE}*[^{SPACE}{LATIN}]+|{SPACE}+")

    def split(self, text: str) -> list[str]:
        """Words of a text between which no piece reaches; joined, they are the text with blanks written as SPACE."""
        return self.words.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def unknown_ids(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        """One word at a time, of any length: what the lattice's fold gives."""
        return self._merged(word) if self.kind == BPE else self._viterbi(word)

    def _merged(self, word: str) -> list[int]:
        """One word's lattice and the fold by rank over it, with a list of borders in place of bits, so of any length."""
        get, n, longest = self.edge.get, len(word), self.longest
        edges = []  # (rank, end, length), packed
        for a in range(n - 1):
            for b in range(a + 2, min(n, a + longest) + 1):
                k = get(word[a:b])
                if k is None:
                    break
                if k >= 0:
                    edges.append(k | b << 8 | b - a)
        edges.sort()
        after = list(range(1, n + 2))
        for k in edges:
            b = k >> 8 & 0xFFFFFFFF
            a = b - (k & 0xFF)
            middle = after[a]
            if middle and middle < b and after[middle] == b:
                after[a], after[middle] = b, 0
        out, a, get = [], 0, self.pieces.get
        while a < n:
            b = after[a]
            i = get(word[a:b])
            if i is None:
                out += self.unknown_ids(word[a])
            else:
                out.append(i)
            a = b
        return out

    def _viterbi(self, word: str) -> list[int]:
        low = min(self.score) - UNKNOWN_PENALTY
        best: list = [(0.0, -1, -1)]
        for end in range(1, len(word) + 1):
            here = None
            for start in range(max(0, end - self.longest), end):
                i = self.pieces.get(word[start:end])
                if i is None and end - start > 1:
                    continue
                s = best[start][0] + (low if i is None else self.score[i])
                if here is None or s > here[0]:
                    here = (s, start, -1 if i is None else i)
            best.append(here)
        out, at = [], len(word)
        while at:
            _, start, i = best[at]
            out.append([i] if i >= 0 else self.unknown_ids(word[start]))
            at = start
        return [x for part in reversed(out) for x in part]


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """(word, edges): for each distinct word, its substrings that are pieces, as (cost, end, length, start, id).

    The words are dealt out once, by word; explode, join and grouping then stay in place.
    """
    spark = words.sparkSession
    table = spark.createDataFrame([(p, i, -model.score[i]) for p, i in model.pieces.items()], "piece string, id int, cost double")
    starts = words.select("word", F.length("word").alias("n"), F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    parts = starts.select("word", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("n"), F.col("start") + model.longest))).alias("end"))
    parts = parts.withColumn("piece", F.substring("word", F.col("start") + 1, F.col("end") - F.col("start")))
    # the piece table is the vocabulary file: its size does not depend on the corpus
    edges = parts.join(F.broadcast(table), "piece")
    return edges.groupBy("word").agg(F.collect_list(F.struct("cost", "end", (F.col("end") - F.col("start")).alias("length"), "start", "id")).alias("edges"))


def _bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), x)


def merge_fold(edges: Column, n: Column) -> Column:
    """A bit for each border that BPE leaves in a word of n letters, ends included."""
    every = _bit(n + 1) - 1

    def take(mask: Column, e: Column) -> Column:
        ends = _bit(e["start"]).bitwiseOR(_bit(e["end"]))
        inner = (_bit(e["end"]) - 1).bitwiseAND(F.bitwise_not(_bit(e["start"] + 1) - 1))
        fits = (mask.bitwiseAND(ends) == ends) & (F.bit_count(mask.bitwiseAND(inner)) == 1)
        return F.when(fits, mask.bitwiseAND(F.bitwise_not(inner))).otherwise(mask)

    return F.aggregate(F.sort_array(F.filter(edges, lambda e: e["length"] > 1)), every, take)


def viterbi_fold(edges: Column, n: Column, low: float) -> Column:
    """A bit for each border of the best segmentation: at each end, the best of the edges that reach it."""
    kind = "array<struct<score:double,borders:bigint>>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("bigint").alias("borders"))).cast(kind)

    def extend(best: Column, end: Column) -> Column:
        before = F.element_at(best, end)
        unknown = F.struct((-(before["score"] + low)).alias("loss"), (end - 1).alias("start"))
        known = F.transform(F.filter(edges, lambda e: e["end"] == end), lambda e: F.struct((e["cost"] - F.element_at(best, e["start"] + 1)["score"]).alias("loss"), e["start"].alias("start")))
        single = F.exists(edges, lambda e: (e["end"] == end) & (e["start"] == end - 1))
        pick = F.array_min(F.concat(F.when(single, F.array().cast("array<struct<loss:double,start:int>>")).otherwise(F.array(unknown)), known))
        return F.concat(best, F.array(F.struct((-pick["loss"]).alias("score"), F.element_at(best, pick["start"] + 1)["borders"].bitwiseOR(_bit(end)).alias("borders")))).cast(kind)

    return F.aggregate(F.sequence(F.lit(1), n), first, extend, lambda best: F.element_at(best, -1)["borders"])


def segmented(folded: DataFrame, model: Model) -> DataFrame:
    """(word, ids) from (word, edges, borders)."""
    n = F.length("word")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.col("borders").bitwiseAND(_bit(i)) != 0)

    def ids(a: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col("starts"), i + 1), n)
        hit = F.filter("edges", lambda e: (e["start"] == a) & (e["end"] == end))
        char = F.substring("word", a + 1, F.lit(1)).cast("binary")
        if model.byte:
            table = F.array(*(F.lit(b) for b in model.byte))
            other = F.transform(F.sequence(F.lit(1), F.length(char)), lambda k: F.element_at(table, F.conv(F.hex(F.substring(char, k, F.lit(1))), 16, 10).cast("int") + 1))
        else:
            other = F.array(F.lit(model.unknown))
        return F.when(F.size(hit) > 0, F.transform(hit, lambda e: e["id"])).otherwise(other)

    return folded.withColumn("starts", starts).select("word", F.flatten(F.transform("starts", ids)).alias("ids"))


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) of distinct words of at most LATTICE_LETTERS code points, by the lattice."""
    own = spread(words.select("word"), "word")
    low = min(model.score) - UNKNOWN_PENALTY
    edges = own.join(lattice(own, model), "word", "left").select("word", F.coalesce("edges", F.array().cast(EDGES)).alias("edges"))
    fold = merge_fold(F.col("edges"), F.length("word")) if model.kind == BPE else viterbi_fold(F.col("edges"), F.length("word"), low)
    return segmented(edges.withColumn("borders", fold), model)


class WordFold:
    """Ids of words beyond the table: the lattices of many words at once, as arrays, and the fold by rank over them.

    Substrings are met letter by letter along a trie of the pieces. A node is the number of its
    prefix, that of one letter the letter's code; 0 is none. Children are found by an open hash.
    """

    def __init__(self, model: Model):
        self.model, self.memo, self.kept, self.most = model, {}, 0, LATTICE_WORDS
        if model.kind != BPE:
            return
        letters = sorted({c for p in model.pieces for c in p})
        self.code = np.zeros(ord(letters[-1]) + 2, np.int64)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: i for i, c in enumerate(letters, 1)}
        self.fan, keys = len(letters) + 1, []
        for p in model.pieces:
            for k in range(2, len(p) + 1):
                if p[:k] not in number:
                    keys.append(number[p[: k - 1]] * self.fan + number[p[k - 1]])
                    number[p[:k]] = len(number) + 1
        self.piece, self.rank = np.full(len(number) + 1, -1, np.int64), np.zeros(len(number) + 1, np.int64)
        rank = {cost: k for k, cost in enumerate(sorted({-model.score[i] for i in model.pieces.values()}))}
        for p, i in model.pieces.items():
            self.piece[number[p]], self.rank[number[p]] = i, rank[-model.score[i]]
        self.place = (LATTICE_LETTERS + 1).bit_length()
        self.id_bits, self.rank_bits = int(self.piece.max()).bit_length(), len(rank).bit_length()
        self.most = min(LATTICE_WORDS, 1 << (63 - self.id_bits - self.rank_bits - 2 * self.place))
        self._hash(np.array(keys, np.uint64), np.arange(len(letters) + 1, len(number) + 1))

    def _hash(self, keys: np.ndarray, nodes: np.ndarray) -> None:
        bits = max(4, (4 * len(keys)).bit_length())
        self.drop, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.nodes[at[put]] = keys[put], nodes[put]
            keys, nodes, at = np.delete(keys, put), np.delete(nodes, put), np.delete(at, put) + 1 & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.drop).astype(np.int64)

    def _children(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        keys = (nodes * self.fan + codes).astype(np.uint64)
        at, out = self._slot(keys), np.zeros(len(keys), np.int64)
        held = self.keys[at]
        hit = held == keys
        out[hit] = self.nodes[at[hit]]
        left = np.flatnonzero(~hit & (held != 0))
        while len(left):
            at[left] = at[left] + 1 & self.last
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.nodes[at[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def encode(self, words: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Each word's row, where its ids begin and the last ones end, and all ids."""
        quick = [w for w in words if len(w) <= LATTICE_LETTERS] if self.model.kind == BPE else []
        slow = [w for w in words if len(w) > LATTICE_LETTERS] if quick else words
        parts = [self._folded(quick[i : i + self.most]) for i in range(0, len(quick), self.most)]
        one = [self._remembered(w) for w in slow]
        lengths = np.concatenate([*(n for n, _ in parts), np.array([len(x) for x in one], np.int64)])
        ids = np.concatenate([*(x for _, x in parts), np.array([i for x in one for i in x], np.int64)])
        return {w: k for k, w in enumerate([*quick, *slow])}, np.concatenate([[0], np.cumsum(lengths)]), ids

    def _remembered(self, word: str) -> list[int]:
        if word not in self.memo:
            if self.kept > KEPT_LETTERS:
                self.memo.clear()
                self.kept = 0
            self.memo[word] = self.model.encode_word(word)
            self.kept += len(word)
        return self.memo[word]

    def _folded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them."""
        sizes = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        begins = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(letters)) - begins[word]
        codes = self.code[np.minimum(letters, len(self.code) - 1)]
        edges = np.sort(self._edges(word, place, codes, (begins + sizes)[word]))
        ids = self.piece[codes]  # at each letter, of the piece that begins there
        borders = self._fold(edges, begins, sizes, ids)
        begin = np.flatnonzero(borders[word] >> place & 1)
        ids, spans = ids[begin], np.ones(len(begin), np.int64)
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            other = [self.model.unknown_ids(chr(c)) for c in letters[begin[unknown]].tolist()]
            spans[unknown] = [len(x) for x in other]
            ids = np.repeat(ids, spans)
            ids[ids < 0] = [i for x in other for i in x]
        return np.bincount(word[begin], spans, len(words)).astype(np.int64), ids

    def _edges(self, word: np.ndarray, place: np.ndarray, codes: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """(word, rank, end, length, id) of each substring of two letters at least that is a piece, packed."""
        at, nodes, size, found = np.arange(len(codes)), codes, 1, [np.zeros(0, np.int64)]
        while len(at):
            on = np.flatnonzero((at + size < stop[at]) & (nodes > 0))
            at, nodes = at[on], nodes[on]
            nodes = self._children(nodes, codes[at + size])
            size += 1
            own = np.flatnonzero(self.piece[nodes] >= 0)
            a, i = at[own], nodes[own]
            e = (word[a] << self.rank_bits | self.rank[i]) << self.place | place[a] + size
            found.append((e << self.place | size) << self.id_bits | self.piece[i])
        return np.concatenate(found)

    def _fold(self, edges: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A bit for each border that BPE leaves in each word, as merge_fold; the k-th edges of all words are taken together."""
        one, low = np.int64(1), (1 << self.place) - 1
        end = edges >> self.id_bits + self.place & low
        start = end - (edges >> self.id_bits & low)
        word = edges >> self.id_bits + 2 * self.place + self.rank_bits
        ends, inside = one << start | one << end, (one << end) - (one << start + 1)
        at, pieces = begins[word] + start, edges & (1 << self.id_bits) - 1
        counts = np.bincount(word, minlength=len(sizes))
        order = np.argsort(-counts, kind="stable")
        first, counts = (np.cumsum(counts) - counts)[order], counts[order]
        mask = (one << (sizes + 1)[order]) - 1
        for k in range(int(counts[0]) if len(counts) else 0):
            now = mask[: np.searchsorted(-counts, -k)]
            e = first[: len(now)] + k
            inner = now & inside[e]
            fits = np.flatnonzero((now & ends[e] == ends[e]) & (inner != 0) & (inner & inner - 1 == 0))
            now[fits] ^= inner[fits]
            ids[at[e[fits]]] = pieces[e[fits]]
        borders = np.empty_like(mask)
        borders[order] = mask
        return borders


class Table:
    """Ids of the words in the table, in one array."""

    def __init__(self, lexicon: Lexicon, offsets: np.ndarray, values: np.ndarray):
        self.lexicon, self.offsets, self.values = lexicon, offsets, values


def word_table(spark: SparkSession, counts: DataFrame, model: Model, limit: int) -> Table:
    """The table of the most frequent words, all of them where `limit` allows."""
    short = most_frequent(counts.filter(F.length("word") <= LATTICE_LETTERS), limit)
    frequent = [r.word for r in short.orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).collect()]
    got = encode_words(short, model).select(F.xxhash64("word").alias("h"), "ids").toArrow()
    ids = got["ids"].combine_chunks()
    offsets = ids.offsets.to_numpy().astype(np.int64)
    values = ids.flatten().to_numpy().astype(np.int32)
    return Table(Lexicon(unsigned(got["h"].to_numpy()), frequent), offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64), values)


def encode(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", table_words: int = TABLE_WORDS) -> DataFrame:
    """(id, ids) of each document row, whole texts; null and empty texts have no ids.

    The model's unknown piece, or its byte pieces where it has them, stand for characters
    that it lacks. Rows that repeat an id or a text are encoded each by itself, and a word
    of any length whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    counts = materialise(count_words(texts, _splitter(model), "string"), "words")
    held = Shared(spark, (model, WordFold(model), word_table(spark, counts, model, table_words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fold, table = held.value
        find, offsets, values, split = table.lexicon.find, table.offsets, table.values, own.split
        for batch in batches:
            for part in pieces_of(batch, 1):
                words, sizes = [], []
                for t in part.column(1).to_pylist():
                    w = split(t) if t else []
                    words += w
                    sizes.append(len(w))
                rows = find(words)
                known = rows >= 0
                rest = np.flatnonzero(~known).tolist()
                row, starts, others = fold.encode(list(dict.fromkeys([words[k] for k in rest])))
                at = np.array([row[words[k]] for k in rest], np.int64)
                begins, lengths = offsets[rows], offsets[rows + 1] - offsets[rows]
                begins[rest], lengths[rest] = starts[at], starts[at + 1] - starts[at]
                ends = np.cumsum(lengths)
                source = np.repeat(begins - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
                inside = np.repeat(known, lengths)
                out = np.empty(len(source), np.int32)
                out[inside], out[~inside] = values[source[inside]], others[source[~inside]]
                last = np.cumsum(sizes)
                bounds = np.concatenate([[0], np.where(last > 0, ends[np.maximum(last, 1) - 1] if len(ends) else 0, 0)])
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out, pa.int32()))], ["id", "ids"])

    return texts.mapInArrow(run, "id bigint, ids array<int>")


def _splitter(model: Model):
    """Only the pattern goes to the workers, not the pieces."""
    words, prefix = model.words, SPACE if model.prefix else ""

    def split(text: str) -> list[str]:
        return words.findall(prefix + text.replace(" ", SPACE))

    return split


def spelt(ids: pa.ListArray, spell: pa.BinaryArray, prefix: bool) -> pa.StringArray:
    """The text of each list of ids, null for null; bytes that are no UTF-8 are replaced."""
    at = ids.offsets.to_numpy()
    lists = pa.ListArray.from_arrays(pa.array(at - at[0]), spell.take(ids.values.slice(at[0], at[-1] - at[0])))
    joined = pc.binary_join(lists, b"")
    try:
        texts = joined.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
    if prefix:
        texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
    return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """(id, ids, text) from (id, ids): the text that the ids spell; null ids give null."""
    held = Shared(encoded.sparkSession, (model.spell, model.prefix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell, prefix = held.value
        spell = pa.array(spell, pa.binary())
        for batch in batches:
            for part in pieces_of(batch, 1, SPELT_IDS):
                yield pa.record_batch([part.column(0), part.column(1), spelt(part.column(1), spell, prefix)], ["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id bigint, ids array<int>, text string")
