"""The quality classifier against plain computations, and on labels that it has not seen."""

import collections
import math
import random
import re
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import quality

DATA = "/root/testdata/sf0.01"


def step(x, steps):
    return next((i for i, s in enumerate(steps) if x <= s), len(steps))


def plain_bins(text):
    t = text or ""
    n = max(len(t), 1)
    words = [w for w in re.split(r"[ \t\n\x0b\f\r|]+", t) if w]
    letters = len(re.sub(r"[ \t\n\x0b\f\r]+", "", t))
    marks = len(re.findall(r"[!|%*#$&@^~<>{}=+_\\/\[\]]", t))
    upper = sum(unicodedata.category(c) == "Lu" for c in t)
    k = max(len(words), 1)
    variety = math.log(max(len(set(words)), 1)) / math.log(k + 1e-9)
    few = len(words)
    return (
        step(marks / n, quality.SHARE_STEPS), step(upper / n, quality.UPPER_STEPS),
        quality.BINS["word_length"] - 1 if few < quality.FEW_FOR_LENGTH else step(letters / k, quality.LENGTH_STEPS),
        quality.BINS["variety"] - 1 if few < quality.FEW_WORDS else step(variety, quality.VARIETY_STEPS),
    )


def texts(n, seed=3):
    r = random.Random(seed)
    words = ["der", "Hund", "läuft", "ÉCOLE", "a", "###", "x|y", "$$", "ab!c", "immer", "Weiter", "und"]
    return [None, "", " \n", *(" ".join(r.choice(words) for _ in range(r.choice([1, 5, 9, 40, 200]))) for _ in range(n))]


def test_bins_and_ratios_equal_a_plain_computation(spark):
    rows = texts(150)
    frame = spark.createDataFrame([(i, t, "h/p", "en") for i, t in enumerate(rows)], "doc_id bigint, text string, source string, lang string")
    bins = quality.binned(frame, "doc_id", "text", "source", "lang")
    got = {r.id: (r.marks, r.upper, r.word_length, r.variety) for r in bins.collect()}
    assert got == {i: plain_bins(t) for i, t in enumerate(rows)}

    r = random.Random(8)
    labels = [(i, r.random() < 0.6) for i in range(len(rows)) if r.random() < 0.7] + [(2, None), (999, True)]
    ratio, share = quality.fit(bins, spark.createDataFrame(labels, "id bigint, good boolean"))
    known = [(i, g) for i, g in labels if g is not None and i < len(rows)]
    assert share == pytest.approx((sum(g for _, g in known) + 1) / (len(known) + 2))
    for k, name in enumerate(("marks", "upper", "word_length", "variety")):
        good, bad = (collections.Counter(got[i][k] for i, g in known if g == kind) for kind in (True, False))
        total = [sum(c.values()) + quality.ALPHA * quality.BINS[name] for c in (good, bad)]
        want = [math.log((good[b] + quality.ALPHA) / total[0]) - math.log((bad[b] + quality.ALPHA) / total[1]) for b in range(quality.BINS[name])]
        if name in quality.SILENT:
            want[-1] = 0.0
        assert ratio[name] == pytest.approx(want)


def test_labels_that_were_not_seen(spark):
    if not Path(DATA).is_dir():
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    found = quality.classify(docs, labels.filter(~held)).select("id", "kept")
    seen = found.join(labels.filter(held).select(F.col("doc_id").alias("id"), "quality"), "id")
    right, n = seen.agg(F.count_if((F.col("quality") > 0) == F.col("kept")), F.count("*")).first()
    assert n > 50 and right / n > 0.9
