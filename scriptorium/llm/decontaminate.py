"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items: `size` consecutive words, or the whole
item where it is shorter. A scan looks at the block of `BLOCK` words that ends where a
window could end: the shift table says how far on the next window can end at the nearest,
so most positions are never looked at; where the shift is 0, the bucket of windows that
end with this block is compared word by word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, materialise, small_batches, text_bytes

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same of bytes read as characters, before lower-casing.
LETTERS = r"[0-9A-Za-z\x80-\xff]+"
#: Words in a block; windows of fewer words take shorter blocks.
BLOCK = 3
#: Benchmark bytes whose patterns are searched for in one scan; tables weigh some 25 times as much in a worker (2.4 MB gave 61 MB).
PATTERN_BYTES = 4 << 20

SCHEMA = "id bigint, n_words bigint, spans array<struct<s:int,e:int>>, items array<string>"


def words_of(body: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and whatever is not ASCII."""
    return WORDS.findall(body.lower())


class WuManber:
    """Shift tables and suffix buckets of all windows, by the windows' length.

    Windows lie in one flat array; a block's entry is its shift, or where it is 0 the
    bucket of windows that end with it, as a negative number. So an entry is two small
    integers, however long the windows are.
    """

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.code: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for name, body in items:
            ids = np.array([self.code.setdefault(w, len(self.code) + 1) for w in words_of(body)], np.int32)
            if m := min(size, len(ids)):
                by_length[m].append((ids, place[name]))
        self.base = len(self.code) + 1
        self.tables = [self._table(m, texts) for m, texts in sorted(by_length.items())]

    def _table(self, m: int, texts: list[tuple[np.ndarray, int]]) -> tuple:
        b = min(BLOCK, m)
        all_windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, m) for ids, _ in texts])
        owner = np.repeat([k for _, k in texts], [len(ids) - m + 1 for ids, _ in texts])
        windows, which = np.unique(all_windows, axis=0, return_inverse=True)
        held = np.unique(np.stack([which.ravel(), owner], 1), axis=0)
        # windows that end alike lie together
        last = [self.key(w) for w in windows[:, m - b :].tolist()]
        order = sorted(range(len(last)), key=last.__getitem__)
        entry: dict[int, int] = {}
        for end in range(b, m):  # the later the block, the smaller the shift, which stands
            entry.update(zip(map(self.key, windows[:, end - b : end].tolist()), repeat(m - end)))
        first = []
        for i, k in enumerate(order):
            if not i or last[k] != last[order[i - 1]]:
                entry[last[k]] = ~len(first)
                first.append(i)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of = place[held[:, 0]]
        by = np.argsort(of, kind="stable")
        begin = np.searchsorted(of[by], np.arange(len(order) + 1))
        return m, b, entry, np.append(first, len(order)), windows[order], begin, held[by, 1]

    def key(self, block) -> int:
        k = 0
        for x in block:
            k = k * self.base + x
        return k

    def search(self, ids: list[int]) -> tuple[list[tuple[int, int]], set]:
        """(first word, behind the last) of all occurrences of windows, merged; items that have one."""
        found, items, n, base = [], set(), len(ids), self.base
        for m, b, entry, first, windows, begin, owner in self.tables:
            far, pos = m - b + 1, m - 1
            while pos < n:
                key = 0
                for x in ids[pos - b + 1 : pos + 1]:
                    key = key * base + x
                step = entry.get(key, far)
                if step > 0:
                    pos += step
                    continue
                here = ids[pos - m + 1 : pos + 1]
                for k in range(first[~step], first[~step + 1]):
                    if windows[k].tolist() == here:
                        found.append((pos - m + 1, pos + 1))
                        items.update(owner[begin[k] : begin[k + 1]].tolist())
                        break
                pos += 1
        return merged(found), {self.names[k] for k in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _shares(benchmark: DataFrame, item_col: str, item_text_col: str, size: int, pattern_bytes: int) -> Iterator[Shared]:
    """Search tables of the benchmark's items, each of a share of bounded size."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text_col).cast("binary").alias("body")).filter("name is not null and body is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("n")).first().n
    shares = max(1, -(-total // pattern_bytes))
    for k in range(shares):
        part = rows if shares == 1 else rows.filter(F.pmod(F.xxhash64("name"), F.lit(shares)) == k)
        yield Shared(benchmark.sparkSession, WuManber(sorted((r.name, bytes(r.body)) for r in part.toLocalIterator()), size))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """(id, n_words, spans, items) of each document: word spans inside occurring windows.

    Null or empty texts have no words, and null or wordless items no windows; rows with the
    same item id are one item; each document row, repeated or not, gets a row of its own.
    Other columns of the inputs are ignored. A benchmark above `pattern_bytes` is searched
    for in several scans, each with the items of a share, so that what goes to the workers
    stays bounded; document rows are then numbered, and spans merged by row.
    """
    shares = list(_shares(benchmark, item_col, item_text_col, size, pattern_bytes))
    bodies = text_bytes(docs, id_col, text_col)
    if len(shares) == 1:
        return bodies.mapInArrow(_scan(shares[0]), SCHEMA)
    rows = materialise(bodies.withColumn("row", F.monotonically_increasing_id()), "numbered")
    scans = [rows.select(F.col("row").alias("id"), "body").mapInArrow(_scan(tables), SCHEMA) for tables in shares]
    hits = reduce(DataFrame.unionByName, (x.filter("size(spans) > 0").select("id", "spans", "items") for x in scans))
    joined = hits.groupBy(F.col("id").alias("row")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    fold = F.expr(
        "aggregate(spans, cast(array() as array<struct<s:int,e:int>>), (acc, x) -> if(size(acc) > 0 and x.s <= element_at(acc, -1).e,"
        " concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(x.e, element_at(acc, -1).e)))), concat(acc, array(x))))"
    )
    none = F.array().cast("array<struct<s:int,e:int>>")
    counted = rows.select("id", "row", F.size(F.regexp_extract_all(F.coalesce(F.decode("body", "ISO-8859-1"), F.lit("")), F.lit(LETTERS), F.lit(0))).cast("bigint").alias("n_words"))
    return counted.join(joined.withColumn("spans", fold), "row", "left").select("id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _scan(tables: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, code = tables.value.search, tables.value.code.get
        for batch in batches:
            n_words, spans, items = [], [], []
            for body in batch.column("body").to_pylist():
                words = words_of(body) if body else []
                hit, names = search([code(w, 0) for w in words])
                n_words.append(len(words))
                spans.append([{"s": s, "e": e} for s, e in hit])
                items.append(sorted(names))
            yield pa.record_batch(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                ["id", "n_words", "spans", "items"],
            )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """The document rows, all columns kept, that hold no window of the benchmark.

    Each row is judged by its own text where it lies: none is shuffled. With several shares
    each scan reads what the one before has left.
    """
    small_batches(docs.sparkSession)
    shares = list(_shares(benchmark, item_col, item_text_col, size, pattern_bytes))
    at, left = docs.columns.index(text_col), docs
    for i, tables in enumerate(shares):

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            search, code = tables.value.search, tables.value.code.get
            for batch in batches:
                clean = [not text or not search([code(w, 0) for w in words_of(text.encode())])[0] for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        left = left.mapInArrow(run, docs.schema)
        if i + 1 < len(shares):
            left = materialise(left, "clean")
    return left
