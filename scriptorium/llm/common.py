"""What several operators of this subpackage share: scratch tables, word counts, links."""

from __future__ import annotations

import atexit
import logging
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where none is set, as in tests."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="scratch-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, which cuts its lineage.

    The table survives the loss of executors; it is removed by discard(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(schema).parquet(path)
    table.__dict__["scratch_path"] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables of materialise() that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t.__dict__["scratch_path"])


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended; its folder is the cluster's to clear
        return
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except (Py4JError, OSError) as e:  # a table that stays costs room, not results
        logging.getLogger(__name__).warning("scratch table %s stays: %s", path, e)


#: Steps of frequency in each doubling of a word's count.
COUNT_STEPS = 16
#: Rows of ids that are broadcast at most; more are joined by shuffling.
BROADCAST_IDS = 1_000_000


def few(rows: DataFrame, most: int = BROADCAST_IDS) -> bool:
    """Whether a table is short enough to be broadcast."""
    return rows.limit(most + 1).count() <= most


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The documents, all columns kept, whose id is not among (id); where ids are few, no document is shuffled."""
    gone = materialise(ids.filter("id is not null").distinct().withColumnRenamed("id", "__gone"), "gone")
    return docs.join(F.broadcast(gone) if few(gone) else gone, F.col(id_col) == F.col("__gone"), "left_anti")


class Shared:
    """A bounded object that goes to each worker once, with the code it needs: workers have no copy of this package."""

    def __init__(self, spark: SparkSession, value: object):
        self.body = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self) -> dict:
        return {"body": self.body}

    @property
    def value(self):
        if "known" not in self.__dict__:
            self.known = cloudpickle.loads(self.body.value)
            self.body.__dict__.pop("_value", None)  # the bytes can be read again
        return self.known


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of an Arrow batch where the session sets none: texts can be long, and each task holds batches on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "0") == "0":
        spark.conf.set(key, str(rows))


def pieces_of(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (or bytes) in a column come to about `size` bytes, a longer one by itself."""
    if not batch.num_rows:
        return
    at = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1]
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Dealt out by columns over as many partitions as the session shuffles to, however few bytes they are: for work that grows out of them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """Of (word, n) the rows above the least frequency that no more than `limit` rows reach: a filter, not a sort that tasks hold in memory."""
    step = F.floor(F.log2("n") * COUNT_STEPS)
    known, least = 0, -1
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        known += r.words
        if known > limit:
            least = r.step
            break
    return counts.filter(step > least)


def text_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, body): the id and the text's UTF-8 bytes, null for null."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))


def count_words(bodies: DataFrame, words_of: Callable, kind: str = "binary", extra: bytes | None = None, flush: int = 100_000) -> DataFrame:
    """(word, n): how often each word of the bodies (a column `body`, binary or string as kind says) occurs; extra is counted once a row.

    Each task combines what it has read before anything is shuffled and holds at most
    `flush` words at a time.
    """
    arrow = pa.string() if kind == "string" else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), arrow), pa.array(list(c.values()), pa.int64())], ["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                if body:
                    seen.update(words_of(body))
                if extra is not None:
                    seen[extra] += 1
                if len(seen) > flush:
                    yield out(seen)
                    seen = Counter()
        if seen:
            yield out(seen)

    found = bodies.select("body").mapInArrow(run, f"word {kind}, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """A bounded table from words to rows, for Python workers: 8 bytes a word.

    Words are known by their XXH64 (seed 42, as Spark's xxhash64); the most frequent ones
    also by themselves, which is the quick way. Values lie beside it, in the rows' order.
    """

    def __init__(self, keys: np.ndarray, frequent: list):
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], order.astype(np.int32)
        import xxhash

        at = self._find(np.array([xxhash.xxh64_intdigest(w, 42) for w in frequent], np.uint64))
        self.frequent = dict(zip(frequent, at.tolist(), strict=True))

    def _find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys) or not len(h):
            return np.full(len(h), -1, np.int64)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, self.rows[at], -1).astype(np.int64)

    def find(self, words: list) -> np.ndarray:
        """The row of each word, -1 where it is not in the table."""
        import xxhash

        get = self.frequent.get
        out = np.array([get(w, -2) for w in words], np.int64)
        rare = np.flatnonzero(out == -2)
        if len(rare):
            digest = xxhash.xxh64_intdigest
            out[rare] = self._find(np.array([digest(words[i], 42) for i in rare.tolist()], np.uint64))
        return out


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).view(np.uint64)


def connected_components(vertices: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each vertex can reach over edges (a, b).

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components
    in MapReduce and Beyond" (2014): each step hangs a vertex's neighbours on its smallest
    one, so no step makes more rows than there are edges, and a few steps suffice also for
    long chains. Each round is cut off by a written table.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_m, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        before, now = now, materialise(small, "edges")
        discard(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == was:
            break
        was = state
    else:
        raise RuntimeError("the components did not settle")
    return vertices.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
