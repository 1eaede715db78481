"""Corpus preparation: samples, splits, grids of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

RATIOS = (0.90, 0.05, 0.05)


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order: each task keeps n of its own."""
    return rows.orderBy(*order).limit(n)


def lot(seed: int, key: str) -> Column:
    """A hash by which rows are drawn and dealt: the same ones each time, on any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def random_rows(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows by a hash of their key: the same ones each time."""
    return rows.orderBy(lot(seed, key), key).limit(n)


def split(rows: DataFrame, *, key: str, text_col: str = "text", total: int | None = 400, ratios: tuple = RATIOS, old_french_only: bool = False, seed: int = 42) -> DataFrame:
    """Adds split (train, dev, test) and img_name: filter first, then the first `total` by key, dealt by hash.

    Sizes are int(n * train), int(n * dev) and the rest. The dealt rows are `total` at most;
    with total None, ranks come from hash ranges, more of them the more rows there are.
    """
    if abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError("ratios must sum to 1")
    taken = rows.filter(text.is_old_french(F.col(text_col))) if old_french_only else rows
    if total is not None:
        taken = first_rows(taken, total, key)
    n = taken.count()
    digits = 1 + (n // CHUNK_ROWS).bit_length() // 4
    dealt = taken.withColumn("__h", lot(seed, key))
    placed = ranked(dealt, {"__range": F.substring("__h", 1, digits)}, ["__h", key], "__rank")
    train, dev = int(n * ratios[0]), int(n * ratios[1])
    place = F.col("__rank")
    name = F.when(place < train, "train").when(place < train + dev, "dev").otherwise("test")
    index = place - F.when(place < train, 0).when(place < train + dev, train).otherwise(train + dev)
    number = F.col("split_index").cast("string")
    padded = F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))  # lpad cuts what is longer
    return placed.withColumns({"split": name, "split_index": index}).withColumn("img_name", F.concat("split", F.lit("_"), padded, F.lit(".png"))).drop("__h", "__rank")


#: Rows of a chunk that are numbered together, about.
CHUNK_ROWS = 1 << 16


def ranked(rows: DataFrame, chunk: dict[str, Column], order: list[str], name: str) -> DataFrame:
    """Adds each row's rank from 0 over the whole table.

    chunk: names and values, not null, that the order begins with or that go up with it.
    Rows are counted by chunk, the counts summed up (one row a chunk), and rows numbered
    inside each: no task holds more than a chunk's rows.
    """
    cut = rows.withColumns(chunk)
    before = F.sum("__n").over(Window.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut.groupBy(*chunk).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*chunk).orderBy(*order)) - 1
    return cut.join(offsets, list(chunk)).withColumn(name, inside + F.col("__before")).drop("__before", *chunk)


def manuscript_split(rows: DataFrame, *, order: str, gen_split: str = "gen_split", total: int | None = None) -> DataFrame:
    """Train and dev rows by their manuscript's split; capped, both keep their proportion and the first rows stay."""
    used = rows.filter(F.col(gen_split).isin("train", "dev"))
    if total is None:
        return used
    n = {r["s"]: r["n"] for r in used.groupBy(F.col(gen_split).alias("s")).agg(F.count("*").alias("n")).collect()}
    every = sum(n.values())
    if total >= every:
        return used
    train = int(total * (n.get("train", 0) / every))
    part = lambda s, k: first_rows(used.filter(F.col(gen_split) == s), k, order)
    return part("train", train).unionByName(part("dev", total - train))


def split_counts(split_rows: DataFrame, by: str = "split") -> DataFrame:
    """(split, n, share)."""
    n = F.count("*")
    return split_rows.groupBy(by).agg(n.alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def language_shares(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(language, n, percent) by the corpus markers."""
    out = rows.groupBy(text.corpus_language(F.col(text_col)).alias("language")).agg(F.count("*").alias("n"))
    return out.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))


def grid(spark: SparkSession, rates: tuple = (5e-5, 1e-4), ranks: tuple = (8, 16)) -> DataFrame:
    """(run_idx, lr, lora_r, lora_alpha): all pairs of settings, alpha twice the rank."""
    lr = spark.createDataFrame([(i, x) for i, x in enumerate(rates)], "i int, lr double")
    r = spark.createDataFrame([(i, x) for i, x in enumerate(ranks)], "j int, lora_r int")
    pairs = lr.crossJoin(r)  # two short lists of settings
    return pairs.select((F.col("i") * len(ranks) + F.col("j")).alias("run_idx"), "lr", "lora_r", (F.col("lora_r") * 2).alias("lora_alpha"))
