"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is the log-likelihood ratio of its text's binned features under
good and bad labelled documents (counts by bin, smoothed). Its site adds a prior: the share
of good documents on its host, shrunk toward the global share, and on its path, shrunk
toward its host's. A labelled document counts with its label, another with the posterior
that its own evidence gives. Few documents on a site move its prior little, many decide it.
A document never counts in the prior that it is held against itself.

The host is the source up to its first `/`; the path is what follows, or the language where
nothing does. Everything is DataFrame expressions and grouped sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, materialise, without_ids

#: Pseudo-documents by which a host leans on the global share, and a path on its host.
HOST_WEIGHT, PATH_WEIGHT = 20.0, 20.0
#: Added to each bin's count.
ALPHA = 0.5
#: What a site's prior may add or take, as a logarithm of odds: a site alone convicts no document.
PRIOR_REACH = 4.0
#: Sites that are broadcast at most; more are joined by shuffling.
BROADCAST_SITES = 200_000

SHARE_STEPS = (0.0, 0.002, 0.01, 0.03, 0.08, 0.2)
UPPER_STEPS = (0.0, 0.05, 0.1, 0.2, 0.4)
LENGTH_STEPS = (3.0, 4.0, 5.0, 6.0, 8.0)
#: log(distinct words) / log(words), which depends little on a text's length.
VARIETY_STEPS = (0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.84, 0.88, 0.92, 0.96)
#: With fewer words, variety and mean length say nothing: the last bin of each, which is no evidence.
FEW_WORDS, FEW_FOR_LENGTH = 8, 40
BINS = {"marks": len(SHARE_STEPS) + 1, "upper": len(UPPER_STEPS) + 1, "word_length": len(LENGTH_STEPS) + 2, "variety": len(VARIETY_STEPS) + 2}
SILENT = {"word_length", "variety"}


def _step(x: Column, steps: tuple) -> Column:
    out = F.lit(len(steps))
    for i in range(len(steps) - 1, -1, -1):
        out = F.when(x <= steps[i], i).otherwise(out)
    return out


def features(text: Column) -> dict[str, Column]:
    """Bins of a text (null as empty): shares of marks and of capitals, mean word length, and variety of words by their number."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.filter(F.split(t, r"[\s|]+"), lambda w: w != "")
    return {
        "marks": _step((F.length(t) - F.length(F.regexp_replace(t, r"[!|%*#$&@^~<>{}=+_\\/\[\]]+", ""))) / n, SHARE_STEPS),
        "upper": _step((F.length(t) - F.length(F.regexp_replace(t, r"[\p{Lu}]+", ""))) / n, UPPER_STEPS),
        "n_letters": F.length(F.regexp_replace(t, r"\s+", "")),
        "n_words": F.size(words),
        "n_distinct": F.size(F.array_distinct(words)),
    }


def binned(docs: DataFrame, id_col: str, text_col: str, host_col: str, section_col: str | None) -> DataFrame:
    """(id, host, path, one bin a feature) of each document row."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    rest = F.regexp_extract(host, "^[^/]*/(.*)$", 1)
    section = F.coalesce(F.col(section_col).cast("string"), F.lit("")) if section_col else F.lit("")
    f = features(F.col(text_col))
    out = docs.select(F.col(id_col).alias("id"), F.split(host, "/", 2)[0].alias("host"), F.when(rest != "", rest).otherwise(section).alias("path"), *(c.alias(k) for k, c in f.items()))
    return out.select("id", "host", "path", "marks", "upper", *derived())


def derived() -> list[Column]:
    words, few = F.greatest("n_words", F.lit(1)).cast("double"), F.col("n_words") < FEW_WORDS
    variety = F.log(F.greatest("n_distinct", F.lit(1)).cast("double")) / F.log(words + 1e-9)
    return [
        F.when(F.col("n_words") < FEW_FOR_LENGTH, BINS["word_length"] - 1).otherwise(_step(F.col("n_letters") / words, LENGTH_STEPS)).alias("word_length"),
        F.when(few, BINS["variety"] - 1).otherwise(_step(variety, VARIETY_STEPS)).alias("variety"),
    ]


def fit(bins: DataFrame, labels: DataFrame) -> tuple[dict[str, list[float]], float]:
    """Log-likelihood ratios by feature and bin, and the global share of good documents.

    labels: (id, good); rows whose label is null are ignored, repeated ones count again.
    What reaches the driver are two counts a bin, however many documents there are.
    """
    known = bins.join(labels.filter("good is not null"), "id")
    long = known.select("good", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).cast("int").alias("bin")) for k in BINS))).alias("x"))
    counts = long.groupBy("x.k", "x.bin").agg(F.sum(F.col("good").cast("int")).alias("good"), F.count("*").alias("n")).collect()
    good = sum(r.good for r in counts if r.k == "marks")
    bad = sum(r.n - r.good for r in counts if r.k == "marks")
    ratio = {}
    for k, size in BINS.items():
        a, b = [ALPHA] * size, [ALPHA] * size
        for r in counts:
            if r.k == k:
                a[r.bin] += r.good
                b[r.bin] += r.n - r.good
        ratio[k] = [math.log(x / sum(a)) - math.log(y / sum(b)) for x, y in zip(a, b, strict=True)]
        if k in SILENT:
            ratio[k][-1] = 0.0
    return ratio, (good + 1) / (good + bad + 2)


def evidence(ratio: dict[str, list[float]]) -> Column:
    out = F.lit(0.0)
    for k, values in ratio.items():
        out = out + F.element_at(F.array(*(F.lit(v) for v in values)), F.col(k).cast("int") + 1)
    return out


def _logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def posterior(bins: DataFrame, labels: DataFrame, ratio: dict[str, list[float]], share: float) -> DataFrame:
    """(id, host, path, evidence, prior, p_quality) of each document row."""
    own = labels.filter("good is not null").groupBy("id").agg(F.avg(F.col("good").cast("double")).alias("label"))
    base = math.log(share) - math.log(1 - share)
    scored = bins.withColumn("evidence", evidence(ratio)).join(own, "id", "left")
    scored = scored.select("id", "host", "path", "evidence", F.coalesce("label", 1 / (1 + F.exp(-(F.col("evidence") + base)))).alias("p"))
    paths = scored.groupBy("host", "path").agg(F.sum("p").alias("path_good"), F.count("*").alias("path_n"))
    hosts = paths.groupBy("host").agg(F.sum("path_good").alias("host_good"), F.sum("path_n").alias("host_n"))
    sites = materialise(paths.join(hosts, "host"), "sites")
    sites = F.broadcast(sites) if few(sites, BROADCAST_SITES) else sites
    host = (F.col("host_good") - F.col("p") + HOST_WEIGHT * share) / (F.col("host_n") - 1 + HOST_WEIGHT)
    path = (F.col("path_good") - F.col("p") + PATH_WEIGHT * host) / (F.col("path_n") - 1 + PATH_WEIGHT)
    prior = F.least(F.greatest(_logit(F.least(F.greatest(path, F.lit(1e-9)), F.lit(1 - 1e-9))), F.lit(-PRIOR_REACH)), F.lit(PRIOR_REACH))
    out = scored.join(sites, ["host", "path"]).withColumn("prior", prior)
    return out.select("id", "host", "path", "evidence", "prior", (1 / (1 + F.exp(-(F.col("evidence") + F.col("prior"))))).alias("p_quality"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", section_col: str | None = "lang", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """(id, host, path, evidence, prior, p_quality, kept) of each document row, whole texts.

    A null or empty text has the bins of an empty text; a null source is the host ''.
    Without labels nothing tells documents apart and all are kept (p_quality 0.5). Rows
    that repeat an id are judged each by its own text. Other columns are ignored.
    """
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).alias("good"))
    bins = materialise(binned(docs, id_col, text_col, host_col, section_col), "bins")
    ratio, share = fit(bins, known)
    return posterior(bins, known, ratio, share).withColumn("kept", F.col("p_quality") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents, all columns kept, that the classifier does not reject; rows that share an id go together if any of them goes."""
    id_col = options.get("id_col", "doc_id")
    return without_ids(docs, classify(docs, labels, **options).filter("not kept").select("id"), id_col)
