"""Text functions as Columns: stripping, languages, confidence, review flags, buckets.

White space is Unicode's, as Java's `\\s` with the U flag has it; SQL's trim takes blanks only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicons as lex

#: Whitespace of str.strip(): Unicode's, and the four separators U+001C to U+001F.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x evaluated once for a row: what stands inside a lambda is else made again for each element."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def is_blank(x: Column) -> Column:
    return F.coalesce(strip(x), F.lit("")) == ""


def tokens(x: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(x, f"{WS}+"), lambda w: w != "")


def blank_guard(x: Column) -> Column:
    """Stripped; one blank where nothing is left, so that lengths are not 0."""
    s = strip(F.coalesce(x, F.lit("")))
    return F.when(s == "", F.lit(" ")).otherwise(s)


def without_image_suffix(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit(".png"), F.lit("")), F.lit(".jpg"), F.lit(""))


def word_set(x: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


def _overlap(words: Column, lexicon: list[str]) -> Column:
    return F.size(F.array_intersect(words, F.array(*(F.lit(w) for w in dict.fromkeys(lexicon)))))


def language_counts(x: Column) -> Column:
    """latin and french: how many distinct marker words of each a text has."""
    return once(word_set(F.coalesce(x, F.lit(""))), lambda w: F.struct(_overlap(w, lex.LATIN_WORDS).alias("latin"), _overlap(w, lex.FRENCH_WORDS).alias("french")))



def dominant(latin: Column, french: Column) -> Column:
    """latin or old_french where one count exceeds 1.5 times the other, else mixed (also without words)."""
    return F.when(latin * 2 > french * 3, "latin").when(french * 2 > latin * 3, "old_french").otherwise("mixed")


def language(x: Column) -> Column:
    return once(language_counts(x), lambda n: dominant(n["latin"], n["french"]))


def _substrings(x: Column, french: list[str], latin: list[str]) -> Column:
    """french and latin: how many markers of each list stand in a text, those that a list names twice counted twice."""
    count = lambda lower, markers: sum((F.contains(lower, F.lit(m)).cast("int") for m in markers), F.lit(0))
    return once(F.lower(F.coalesce(x, F.lit(""))), lambda t: F.struct(count(t, french).alias("french"), count(t, latin).alias("latin")))


def old_french(x: Column) -> Column:
    """french, latin (counts of markers) and is_old_french."""
    flag = lambda n: F.struct(n["french"].alias("french"), n["latin"].alias("latin"), ((n["french"] > n["latin"]) & (n["french"] >= 2)).alias("is_old_french"))
    return once(_substrings(x, lex.FRENCH_FILTER, lex.LATIN_FILTER), flag)


def is_old_french(x: Column) -> Column:
    return old_french(x)["is_old_french"]


def corpus_language(x: Column) -> Column:
    """old_french or latin by the larger count of substring markers, unknown where they tie."""
    return once(_substrings(x, lex.FRENCH_CORPUS, lex.LATIN_CORPUS), lambda n: F.when(n["french"] > n["latin"], "old_french").when(n["latin"] > n["french"], "latin").otherwise("unknown"))


# Confidence by error rate, upper bounds of half-open ranges.
CALIBRATION = ((0.05, 0.95), (0.10, 0.90), (0.15, 0.85), (0.20, 0.75), (0.30, 0.65), (0.50, 0.50), (0.75, 0.35), (1.00, 0.20))
# Names of error and confidence buckets, upper bounds.
CER_BUCKETS = ((0.05, "excellent"), (0.15, "bon"), (0.30, "moyen"), (0.50, "mauvais"))
CONFIDENCE_BUCKETS = ((0.5, "<0.5"), (0.7, "0.5-0.7"), (0.8, "0.7-0.8"), (0.9, "0.8-0.9"))


def _ranges(x: Column, steps, other) -> Column:
    out = F.lit(other)
    for bound, value in reversed(steps):
        out = F.when(x < bound, F.lit(value)).otherwise(out)
    return out


def calibrated_confidence(cer: Column) -> Column:
    """Confidence of an error rate; 0.10 outside all ranges, negative rates too."""
    return F.when(cer < 0, F.lit(0.10)).otherwise(_ranges(cer, CALIBRATION, 0.10))


def cer_bucket(cer: Column) -> Column:
    return _ranges(cer, CER_BUCKETS, "catastrophique")


def confidence_bucket(c: Column) -> Column:
    return _ranges(c, CONFIDENCE_BUCKETS, ">=0.9")


def title_colour(cer: Column) -> Column:
    return _ranges(cer, ((0.1, "green"), (0.3, "orange")), "red")


# Colours of region types.
REGION_COLOURS = {"main_text": "blue", "marginalia": "orange", "heading": "green", "illustration": "purple"}


def region_colour(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in REGION_COLOURS.items() for x in kv))[kind], F.lit("gray"))


def fallback_confidence(text: Column, base: Column) -> Column:
    """Confidence without truth: the segmenter's, less for very short, very long or monotonous texts."""
    n = F.length(strip(text))
    kinds = F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))
    by_length = F.when(n <= 2, 0.5).when(n > 100, 0.9).otherwise(1.0)
    by_variety = F.when((kinds < 3) & (F.length(text) > 5), 0.3).otherwise(1.0)
    return F.least(base * by_length * by_variety, F.lit(1.0))


def line_confidence(has_truth: Column, cer: Column, text: Column, base: Column, image_found: Column | None = None) -> Column:
    """Calibrated where there is truth and an error, else the fallback; a line without its image has 0.10."""
    chosen = F.when(has_truth & (cer > 0), calibrated_confidence(cer)).otherwise(fallback_confidence(text, base))
    return chosen if image_found is None else F.when(image_found, chosen).otherwise(F.lit(0.10))


def is_suspicious(text: Column) -> Column:
    """Blank; one character repeated; no letter or digit; or a word of more than 40 characters."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    one = F.size(F.array_distinct(F.filter(F.split(F.lower(t), ""), lambda c: c != ""))) == 1
    longest = F.coalesce(F.array_max(F.transform(tokens(t), lambda w: F.length(w))), F.lit(0))
    return is_blank(t) | (one & (n > 3)) | ((~t.rlike(r"[\p{L}\p{N}]")) & (n > 2)) | (longest > 40)


def needs_review(text: Column, confidence: Column, threshold: float = 0.80) -> Column:
    return (confidence < threshold) | (F.length(strip(F.coalesce(text, F.lit("")))) <= 1) | is_suspicious(text)


def context(text: Column, start: Column, end: Column, reach: int = 30) -> Column:
    """The text around a span of 0-based code point offsets, stripped."""
    first = F.greatest(start - reach, F.lit(0))
    return strip(F.substring(text, first + 1, F.least(end + reach, F.length(text)) - first))


def mock_transcription(reading_order: Column) -> Column:
    lines = F.array(*(F.lit(x) for x in lex.MOCK_LINES))
    return F.element_at(lines, (reading_order % len(lex.MOCK_LINES) + 1).cast("int"))


def mock_confidence(line_id: Column) -> Column:
    """In [0.70, 0.95), by a hash of the line, so that it is the same each time."""
    return F.lit(0.70) + F.pmod(F.xxhash64(line_id), F.lit(10_000)) * (0.25 / 10_000)


def accuracy(cer: Column) -> Column:
    return F.lit(1.0) - cer


def count_alert(truth_lines: Column, found_lines: Column, limit: float = 0.15) -> Column:
    return F.abs(truth_lines - found_lines) / F.greatest(truth_lines, F.lit(1)) > limit


def folded(x: str) -> str:
    """A form in which whatever re.IGNORECASE takes for the same is the same, or more is."""
    return x.casefold().replace("\u0131", "i").replace("i\u0307", "i")


class Normaliser:
    """NFC, abbreviations, spellings, white space: in this order, each list in its own.

    A step is tried only where its key stands in the text, borders and case aside. Keys with
    signs of their own are looked for by these, the others are words.
    """

    def __init__(self):
        self.steps = [(folded(k), re.compile(r"\b" + re.escape(k) + r"\b", re.IGNORECASE), v) for k, v in [*lex.ABBREVIATIONS, *lex.VARIANTS]]
        keys = [k for k, *_ in self.steps]
        self.words = frozenset(k for k in keys if k.isascii() and k.isalpha())
        self.signs = sorted({next((c for c in k if not c.isalnum()), max(k)) for k in keys if k not in self.words})
        self.word = re.compile(r"\w+")

    def __call__(self, text: str | None) -> str:
        if not text:
            return ""
        text = unicodedata.normalize("NFC", text)
        lower = folded(text)
        if any(c in lower for c in self.signs) or not self.words.isdisjoint(folded(" ".join(self.word.findall(text))).split()):
            for key, pattern, value in self.steps:
                if key in lower:
                    new = pattern.sub(value, text)
                    if new != text:
                        text, lower = new, folded(new)
        return " ".join(text.split())


NORMALISER = Normaliser()


@F.arrow_udf(T.StringType())
def normalise(x: pa.Array) -> pa.Array:
    """Normalised texts; null and empty ones are empty. Python's word borders and case folding are part of the result."""
    return pa.array([NORMALISER(s) for s in x.to_pylist()], pa.string())
