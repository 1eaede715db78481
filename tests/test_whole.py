"""Queries take whole texts, pages and corpora: each test fails on a prefix or a sample."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import distance
from scriptorium.operators import corpus, metrics, nlp
from scriptorium.plans import queries
from scriptorium.sources import writers


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates_are_of_whole_texts(spark, tmp_path):
    turns = ["é" * 3 + " word" * 40 + " end", "e" * 3 + " word" * 39 + " other éna 🙂 end", "short"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(turns)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = list(zip(turns, turns[1:]))
    chars, words = [edits(a, b) for a, b in pairs], [edits(a.split(), b.split()) for a, b in pairs]
    got = sorted(queries.line_cer(spark, str(tmp_path)).collect(), key=lambda r: r.turn)
    assert [(r.char_edits, r.char_len) for r in got] == [(e, len(a)) for e, (a, _) in zip(chars, pairs)]
    got = sorted(queries.line_wer(spark, str(tmp_path)).collect(), key=lambda r: r.turn)
    assert [(r.word_edits, r.word_len) for r in got] == [(e, len(a.split())) for e, (a, _) in zip(words, pairs)]
    micro = queries.corpus_cer_micro(spark, str(tmp_path)).first()
    assert (micro.char_edits, micro.word_edits) == (sum(chars), sum(words))
    cer = [e / len(a) for e, (a, _) in zip(chars, pairs)]
    assert queries.page_cer_macro(spark, str(tmp_path)).first().cer_global == pytest.approx(sum(cer) / 2, abs=1e-6)
    b = queries.cer_buckets(spark, str(tmp_path)).first()
    assert (b.excellent, b.bon, b.moyen, b.mauvais, b.catastrophique) == tuple(sum(lo <= c < hi for c in cer) for lo, hi in ((0, 0.05), (0.05, 0.15), (0.15, 0.3), (0.3, 0.5), (0.5, 9)))
    swapped = [e / len(p) for e, (_, p) in zip(chars, pairs)]
    lo, step = min(swapped), (max(swapped) - min(swapped)) / 20
    at = sorted(min(19, math.floor((c - lo) / step)) for c in swapped)
    assert sorted(r.bin for r in queries.cer_swapped_hist(spark, str(tmp_path)).collect() for _ in range(r.n)) == at


def test_every_distinct_word_counts(spark):
    row = spark.createDataFrame([(["a"], [f"w{i}" for i in range(20_050)])], "t array<string>, p array<string>")
    assert row.select(distance.token_edits(F.col("t"), F.col("p"))).first()[0] == 20_050


def test_images_have_all_pages_and_pixels(spark, tmp_path):
    counts = {1: 7, 2: 600, 3: 601, 4: 95}
    rows = [(k, i, 1, (i * 37 + k) % 251 + (i == n - 1) * 1004) for k, n in counts.items() for i in range(n)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    values = {str(k): [v % 256 for s, _, _, v in rows if s == k] for k in counts}
    got = {r.page_id: r for r in queries.image_statistics(spark, str(tmp_path)).collect()}
    assert {k: (r.height * r.width, r.mean, r.std, r.min, r.max) for k, r in got.items()} == {k: (len(v), pytest.approx(np.mean(v), abs=1e-6), pytest.approx(np.std(v), abs=1e-6), min(v), max(v)) for k, v in values.items()}
    made = {r.page_id: bytes(r.pixels) for r in queries._rasters(spark, str(tmp_path), 30).collect()}
    assert made == {k: bytes(v) + b"\xff" * (-len(v) % 30) for k, v in values.items()}
    assert {r.page_id for r in queries.image_prepared(spark, str(tmp_path)).collect()} == set(values)


def test_topics_see_every_document_in_each_pass(spark):
    themes = [[f"{a}{b}" for b in "abcde"] for a in ("mer", "nef", "roi", "vin")]
    rows = [(" ".join(themes[i % 4] * 300),) for i in range(8)]
    found = nlp.topics(spark.createDataFrame(rows, "text string"), text_col="text", n_topics=8, words=10).collect()
    best = {w for r in found for w, x in zip(r.words, r.weights) if x > 0.09}
    assert best == {w for t in themes for w in t}


def test_names_of_large_splits_are_not_cut(spark):
    got = corpus.split(spark.range(11_200).withColumn("text", F.lit("x")), key="id", total=None).select("split", "split_index", "img_name").collect()
    assert all(r.img_name == f"{r.split}_{r.split_index:04d}.png" for r in got) and len({r.img_name for r in got}) == 11_200


def test_curves_measure_each_line_once(spark):
    values = [0.5, 0.001, 0.5, 2.0, None, 0.009, 0.5, 0.0] + [i / 7 for i in range(30)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def cer(x):
        seen.add(1)
        return x

    got = writers.error_curve(spark.createDataFrame([(v,) for v in values], "x double").select(cer("x").alias("cer")).filter("true")).collect()
    assert sorted((r.place, r.value) for r in got) == list(enumerate(sorted(v for v in values if v is not None), 1))
    assert seen.value <= 2 * len(values)  # one for the filter, one for the value


def test_texts_are_stripped_once_for_all_metrics(spark):
    scored = metrics.with_metrics(spark.createDataFrame([(" a b ", "a c")], "truth string, pred string"), "truth", "pred")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(coalesce(") == 2 * 2 and scored.columns == ["truth", "pred", "char_edits", "char_len", "word_edits", "word_len", "cer", "wer"]
    assert tuple(scored.first())[2:6] == (1, 3, 1, 2)


def test_topics_count_words_without_keeping_them(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizer

    monkeypatch.setattr(CountVectorizer, "fit", None)  # it keeps all words of all documents as objects
    rows = [(f"nef roi mer w{i} vin toujours partout " + "vin " * (i % 3),) for i in range(38)] + [("partout w0",)] * 2 + [("partout",)]
    found = nlp.topics(spark.createDataFrame(rows, "text string"), text_col="text", n_topics=2, words=10, passes=2).collect()
    assert {w for r in found for w in r.words} == {"nef", "roi", "mer", "toujours", "vin", "w0"}  # not those of one document, or of all
