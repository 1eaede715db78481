"""Error rates of lines, pages and corpora; histograms; the best of several runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance, text


def with_metrics(lines: DataFrame, truth: str = "ground_truth", pred: str = "text") -> DataFrame:
    """Adds char_edits, char_len, word_edits, word_len, cer and wer."""
    # step by step, so that each form of a text is made once
    cleaned = lines.withColumns({"__t": text.blank_guard(F.col(truth)), "__p": text.blank_guard(F.col(pred))})
    split = cleaned.withColumns({"__tw": text.tokens(F.col("__t")), "__pw": text.tokens(F.col("__p"))})
    m = distance.cleaned_metrics(*(F.col(c) for c in ("__t", "__p", "__tw", "__pw")))
    return split.withColumns(m).withColumns({"cer": F.col("char_edits") / F.col("char_len"), "wer": F.col("word_edits") / F.col("word_len")}).drop("__t", "__p", "__tw", "__pw")


def micro(scored: DataFrame, *by: str) -> DataFrame:
    """Corpus rates: all edits over all reference lengths."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("char_edits", "char_len", "word_edits", "word_len")]
    out = scored.groupBy(*by).agg(F.count("*").alias("num_samples"), *sums)
    return out.withColumns({"cer": F.col("char_edits") / F.col("char_len"), "wer": F.col("word_edits") / F.col("word_len")}).withColumn("accuracy", text.accuracy(F.col("cer")))


def macro(scored: DataFrame, *by: str, truth: str = "ground_truth") -> DataFrame:
    """Page rates: means over the lines that have a truth; 0 where none has."""
    has = F.coalesce(F.col(truth), F.lit("")) != ""
    mean = lambda c: F.coalesce(F.avg(F.when(has, F.col(c))), F.lit(0.0)).alias(f"{c}_global")
    return scored.groupBy(*by).agg(mean("cer"), mean("wer"), F.count_if(has).alias("num_aligned"))


BUCKETS = [name for _, name in text.CER_BUCKETS] + ["catastrophique"]


def bucket_counts(scored: DataFrame, *by: str) -> DataFrame:
    """One column a bucket, empty buckets as 0."""
    return scored.groupBy(*by).agg(*(F.count_if(text.cer_bucket(F.col("cer")) == b).alias(b) for b in BUCKETS))


def swapped_cer(truth: Column, pred: Column) -> Column:
    """Error rate over the prediction's length; 1 where there is no prediction."""
    t, p = text.strip(F.coalesce(truth, F.lit(""))), text.strip(F.coalesce(pred, F.lit("")))
    return F.when(p == "", 1.0).otherwise(F.levenshtein(p, t) / F.length(p))


def histogram(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) in equal steps from the least to the greatest value, all bins present."""
    span = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(step > 0, F.least(F.floor((F.col(column) - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0)
    counts = values.crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row on the right
    every = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.col("lo"), step.alias("step"))
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def best_run(runs: DataFrame, metric: str = "cer", order: str = "run_idx") -> DataFrame:
    """The run of the lowest metric; of equal ones the first."""
    if metric not in ("cer", "wer"):
        raise ValueError("metric must be cer or wer")
    best = F.min_by(F.struct(*runs.columns), F.struct(metric, order)).alias("best")
    return runs.filter(F.col(metric).isNotNull()).agg(best).filter("best is not null").select("best.*")


def best_epoch(history: DataFrame, *by: str, metric: str = "cer") -> DataFrame:
    """(epoch, value) of the lowest metric of each run; of equal ones the first."""
    return history.filter(F.col(metric).isNotNull()).groupBy(*by).agg(F.min_by("epoch", F.struct(metric, "epoch")).alias("epoch"), F.min(metric).alias(metric))
