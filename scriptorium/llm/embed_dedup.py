"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are rotated onto the principal axes (fitted on a bounded sample; the rotation
changes no product, only where its mass lies) and cut into blocks along the first. Two
blocks are compared in tiles: products of the leading dimensions first; what the rest can
add is at most the product of the suffix norms, so a pair that cannot reach the threshold
is dropped there. Survivors are confirmed by the cosine of the original vectors in double
precision. Equal vectors are compared once.

Each block goes to the cells of all blocks that it can meet: as many copies of a vector as
there are blocks. Blocks are as large as memory allows, but at least so many that their cells
keep the cluster busy. A cell yields no pairs: only how many links each vector has, and a spanning
forest of the links, at most one row a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, connected_components, materialise

#: Bytes of vectors in a block, and vectors in a tile's side, and in the sample that axes and cuts are fitted on.
BLOCK_BYTES, TILE, SAMPLE = 16 << 20, 512, 8192
#: Leading dimensions of the stages.
STAGES = (8, 24)
#: Room for rounding in the bounds; confirmation is exact.
SLACK = 1e-6


class Axes:
    """Principal axes and cuts along the first."""

    def __init__(self, sample: np.ndarray, blocks: int):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        _, v = np.linalg.eigh(unit.T @ unit)
        self.basis = np.ascontiguousarray(v[:, ::-1])
        self.cuts = np.quantile((unit @ self.basis)[:, 0], np.arange(1, blocks) / blocks) if blocks > 1 else np.empty(0)

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.basis


def suffix_norms(u: np.ndarray, at: int) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (u[:, at:] ** 2).sum(1)))


def linked(x: np.ndarray, y: np.ndarray, axes: Axes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y whose cosine reaches the threshold."""
    u, v = axes.rotated(x), axes.rotated(y)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    dim = x.shape[1]
    stages = [s for s in STAGES if s < dim]
    out_a, out_b = [], []
    for i in range(0, len(x), TILE):
        for j in range(0, len(y), TILE):
            ui, vj = u[i : i + TILE], v[j : j + TILE]
            if stages:
                s = stages[0]
                bound = ui[:, :s] @ vj[:, :s].T
                bound += np.outer(suffix_norms(ui, s), suffix_norms(vj, s))
                a, b = np.nonzero(bound >= threshold - SLACK)
                for s in stages[1:]:
                    if len(a) > TILE * TILE // 8:  # dense: the whole tile is cheaper than single pairs
                        break
                    part = np.einsum("ij,ij->i", ui[a, :s], vj[b, :s]) + suffix_norms(ui, s)[a] * suffix_norms(vj, s)[b]
                    keep = part >= threshold - SLACK
                    a, b = a[keep], b[keep]
            else:
                a, b = (k.ravel() for k in np.indices((len(ui), len(vj))))
            if len(a) > TILE * TILE // 8:
                cos = (x[i : i + TILE] @ y[j : j + TILE].T) / np.outer(nx[i : i + TILE], ny[j : j + TILE])
                a, b = np.nonzero(cos >= threshold)
            elif len(a):
                cos = np.einsum("ij,ij->i", x[i + a], y[j + b]) / (nx[i + a] * ny[j + b])
                a, b = a[cos >= threshold], b[cos >= threshold]
            out_a.append(a + i)
            out_b.append(b + j)
    return np.concatenate(out_a), np.concatenate(out_b)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links (a, b) among n nodes connect, at most one a node."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def similar(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, block: int | None = None) -> DataFrame:
    """(id, n_links, component) of each vector row; block is how many vectors a block holds, if it is not to follow from their size.

    A vector that is null, empty, zero or holds null or non-finite components has no link;
    vectors of different lengths have none. Rows with equal vectors are linked with each
    other. component is the smallest id that links reach. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.coalesce(F.forall("vec", finite) & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("vec", F.when(good, F.col("vec")))
    classes = materialise(rows.filter("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "classes")
    dims = [r.d for r in classes.groupBy(F.size("vec").alias("d")).count().filter("count > 1").orderBy("d").select("d").collect()]
    found = None
    for dim in dims:
        part = _compared(classes.filter(F.size("vec") == dim), threshold, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a bigint, b bigint, links bigint")
    found = materialise(found, "links")
    degree = found.filter("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected_components(classes.select(F.col("rep").alias("id")), found.filter("b is not null").select("a", "b"))
    per_class = classes.join(degree, "rep", "left").join(component.withColumnRenamed("id", "rep"), "rep")
    per_class = per_class.select("vec", "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    found = rows.filter("vec is not null").join(per_class, "vec").select("id", F.col("n_links").cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component"))
    # vectors that link with nothing do not meet in a join
    return found.unionByName(rows.filter("vec is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component")))


def _compared(classes: DataFrame, threshold: float, block: int | None) -> DataFrame:
    """(a, b, links): links > 0 counts links of a; b is not null where an edge joins a with b."""
    spark = classes.sparkSession
    n, dim = classes.select(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    busy = int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))
    block = block or max(TILE, min(BLOCK_BYTES // (8 * max(1, dim)), -(-n // busy)))
    blocks = max(1, -(-n // block))
    sample = np.array([r.vec for r in classes.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()])
    axes = Shared(spark, Axes(sample, blocks))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf.vec.to_numpy())
            u = axes.value.rotated(x)
            bucket = np.searchsorted(axes.value.cuts, u[:, 0], "right")
            yield pd.DataFrame({"bucket": bucket.astype(np.int64), "low": u[:, 0], "rep": pdf.rep, "weight": pdf.weight, "body": [v.tobytes() for v in x]})

    placed = materialise(classes.select("rep", "weight", "vec").mapInPandas(place, "bucket bigint, low double, rep bigint, weight bigint, body binary"), "placed")
    # a bucket that many vectors share is dealt into blocks of bounded size
    share = placed.groupBy("bucket").agg(F.count("*").alias("c"), F.min("low").alias("lo"), F.max("low").alias("hi")).orderBy("bucket").collect()
    names, first = [], {}
    for r in share:
        first[r.bucket] = (len(names), -(-r.c // block))
        names += [(len(names) + i, r.lo, r.hi) for i in range(first[r.bucket][1])]
    deal = spark.createDataFrame([(k, a, s) for k, (a, s) in first.items()], "bucket bigint, base bigint, splits bigint")
    with_block = placed.join(F.broadcast(deal), "bucket").withColumn("block", F.col("base") + F.pmod(F.xxhash64("rep", F.lit(5)), F.col("splits")))

    # unit vectors that far apart along one axis cannot be so close; blocks come by their least value
    apart = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    low, high = np.array([lo for _, lo, _ in names]), np.array([hi for _, _, hi in names])
    last = np.searchsorted(low, high + apart, "right") - 1
    first = np.searchsorted(np.maximum.accumulate(high), low - apart, "left")
    reach = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(first, last, strict=True))], "block bigint, first bigint, last bigint")
    other = F.explode(F.sequence("first", "last")).alias("other")
    cell = (F.least("block", "other") * len(names) + F.greatest("block", "other")).alias("cell")
    dealt = with_block.join(F.broadcast(reach), "block").select("block", "rep", "weight", "body", other).select("rep", "weight", "body", cell, (F.col("block") == F.col("other")).alias("same"), (F.col("block") > F.col("other")).cast("int").alias("side"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = bool(pdf.same.iloc[0])
        x, y = (pdf, pdf) if same else (pdf[pdf.side == 0], pdf[pdf.side == 1])
        matrix = lambda p: np.frombuffer(b"".join(p.body), np.float64).reshape(len(p), -1)
        none = pd.DataFrame({"a": [], "b": [], "links": []}).astype({"a": "int64", "b": "Int64", "links": "int64"})
        if not len(x) or not len(y):
            return none
        a, b = linked(matrix(x), matrix(y), axes.value, threshold)
        rx, ry, wx, wy = (p.to_numpy() for p in (x.rep, y.rep, x.weight, y.weight))
        if same:
            other = rx[a] != ry[b]
            a, b = a[other], b[other]
        if not len(a):
            return none
        links = [np.bincount(a, wy[b], len(rx))] + ([] if same else [np.bincount(b, wx[a], len(ry))])
        ids = np.concatenate([rx] if same else [rx, ry])
        count = np.concatenate(links).astype(np.int64)
        nodes, inverse = np.unique(np.concatenate([rx, ry]), return_inverse=True)
        ea, eb = forest(len(nodes), inverse[a], inverse[len(rx) + b])
        out = pd.DataFrame({"a": np.concatenate([ids, nodes[ea]]), "b": pd.array([None] * len(ids) + nodes[eb].tolist(), "Int64"), "links": np.concatenate([count, np.zeros(len(ea), np.int64)])})
        return out[(out.links > 0) | out.b.notna()]

    partitions = min(len(names) * (len(names) + 1) // 2, 20_000)
    return dealt.repartition(max(1, partitions), "cell").groupBy("cell").applyInPandas(compare, "a bigint, b bigint, links bigint")
