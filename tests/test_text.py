"""Text functions against plain Python, on random Unicode strings and exact borders."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import distance, lexicons, text

R = random.Random(1)
ODD = ["", " ", "\t\n", " x ", "a", "aaaa", "AAAa", "...", "..", "x" * 41, "x" * 40, "été", "été", "ſit", "İ", "Nostre carta", "p̃dicati p̃", "& et ⁊", "\U0001f642\U0001f642"]
TEXTS = ODD + ["".join(R.choice("abAB .é̃\t-12_") for _ in range(R.randint(0, 50))) for _ in range(300)]


def values(spark, *columns, texts=TEXTS):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [tuple(r)[1:] for r in frame.select("i", *columns).orderBy("i").collect()]


def test_strip_and_tokens(spark):
    got = values(spark, text.strip(F.col("text")), text.tokens(F.col("text")))
    assert got == [(t.strip(), t.split()) for t in TEXTS]


def normal(t):
    if not t:
        return ""
    t = unicodedata.normalize("NFC", t)
    for k, v in [*lexicons.ABBREVIATIONS, *lexicons.VARIANTS]:
        t = re.sub(r"\b" + re.escape(k) + r"\b", v, t, flags=re.I)
    return re.sub(r"\s+", " ", t).strip()


def test_normal_forms(spark):
    assert [x for (x,) in values(spark, text.normalise("text"))] == [normal(t) for t in TEXTS]
    assert normal("p̃dicati") == "perdicati" and normal("Nostre") == "nostre" and normal("ñ") == "ñ"


def flagged(t):
    if not t.strip():
        return True
    return (len(set(t.lower())) == 1 and len(t) > 3) or (not any(c.isalnum() for c in t) and len(t) > 2) or max(map(len, t.split())) > 40


def test_suspicious_and_review(spark):
    plain = [t for t in TEXTS if "İ" not in t]  # its lower case has two letters
    got = values(spark, text.is_suspicious(F.col("text")), text.needs_review(F.col("text"), F.lit(0.8)), texts=plain)
    assert got == [(flagged(t), len(t.strip()) <= 1 or flagged(t)) for t in plain]


def fallback(t, base):
    n = len(t.strip())
    c = base * (0.5 if n <= 2 else 0.9 if n > 100 else 1.0)
    return min(c * (0.3 if len(set(t)) < 3 and len(t) > 5 else 1.0), 1.0)


def test_fallback_confidence(spark):
    got = values(spark, text.fallback_confidence(F.col("text"), F.lit(0.9)))
    assert [x for (x,) in got] == pytest.approx([fallback(t, 0.9) for t in TEXTS])


@pytest.mark.parametrize(("cer", "want"), [(-0.1, 0.10), (0.0, 0.95), (0.049, 0.95), (0.05, 0.90), (0.1, 0.85), (0.15, 0.75), (0.2, 0.65), (0.3, 0.5), (0.5, 0.35), (0.75, 0.2), (1.0, 0.1), (7.0, 0.1)])
def test_calibration_borders(spark, cer, want):
    from scriptorium.operators import align

    assert spark.range(1).select(text.calibrated_confidence(F.lit(cer))).first()[0] == want
    table = spark.createDataFrame([(0.0, 0.05, 0.95), (0.05, 0.10, 0.90), (0.10, 0.15, 0.85), (0.15, 0.20, 0.75), (0.20, 0.30, 0.65), (0.30, 0.50, 0.50), (0.50, 0.75, 0.35), (0.75, 1.0, 0.20), (1.0, float("inf"), 0.10)], "low double, high double, confidence double")
    assert align.calibrate(spark.createDataFrame([(cer,)], "cer double"), table).first().confidence == want


def test_perfect_lines_take_the_fallback(spark):
    row = spark.range(1).select(text.line_confidence(F.lit(True), F.lit(0.0), F.lit("a good line"), F.lit(0.9)), text.line_confidence(F.lit(True), F.lit(0.2), F.lit("x"), F.lit(0.9), F.lit(False)))
    assert tuple(row.first()) == (0.9, 0.10)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances(spark):
    pairs = [(R.choice(TEXTS), R.choice(TEXTS)) for _ in range(300)] + [("", ""), ("", "x"), ("a b", ""), ("a b a", "b a b"), ("été", "ete")]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, t string, p string")
    got = frame.select("i", *(c.alias(k) for k, c in distance.line_metrics(F.col("t"), F.col("p")).items())).orderBy("i").collect()
    for r, (t, p) in zip(got, pairs, strict=True):
        a, b = t.strip() or " ", p.strip() or " "
        want = (edits(a, b), len(a), edits(a.split(), b.split()), len(a.split())) if a.split() else (int(a != b), 1, int(a != b), 1)
        assert tuple(r)[1:] == want, (t, p)


def test_languages(spark):
    texts = ["in nomine et ad de cum", "le la les du des", "", "et qui", "donna le chevalier la nostre "]
    got = values(spark, text.language(F.col("text")), text.corpus_language(F.col("text")), text.is_old_french(F.col("text")), texts=texts)
    assert [g[0] for g in got] == ["latin", "old_french", "mixed", "mixed", "old_french"]
    assert [g[1] for g in got] == ["latin", "old_french", "unknown", "unknown", "old_french"]
    assert got[4][2] and not got[2][2]


def test_small_functions(spark):
    row = spark.range(1).select(
        text.without_image_suffix(F.lit("a.png.jpg.x")), text.cer_bucket(F.lit(0.5)), text.confidence_bucket(F.lit(0.7)), text.title_colour(F.lit(0.1)), text.region_colour(F.lit("?")), text.blank_guard(F.lit("\t")), text.context(F.lit("0123456789"), F.lit(4), F.lit(5), 2), text.count_alert(F.lit(20), F.lit(17)), text.count_alert(F.lit(20), F.lit(16)), text.mock_transcription(F.lit(11)), text.accuracy(F.lit(0.25)),
    )
    assert tuple(row.first()) == ("a.x", "catastrophique", "0.7-0.8", "orange", "gray", " ", "23456", False, True, lexicons.MOCK_LINES[1], 0.75)
