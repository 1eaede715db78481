"""Edit distances and error rates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_guard, once, tokens

#: Where letters for distinct tokens begin: above the surrogates and the byte order mark, with room for a million.
FIRST_LETTER = 0x10000


def char_edits(truth: Column, pred: Column) -> Column:
    return F.levenshtein(truth, pred)


def _spelt(words: Column, letters: Column) -> Column:
    code = lambda w: F.lpad(F.hex(F.array_position(letters, w) + (FIRST_LETTER - 1)), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-32")


def token_edits(truth: Column, pred: Column) -> Column:
    """Levenshtein distance of two arrays of words, by the JVM's own on one letter a distinct word.

    More distinct words than there are letters are an error, not a smaller distance.
    """
    return once(F.array_union(truth, pred), lambda letters: F.levenshtein(_spelt(truth, letters), _spelt(pred, letters)))


def line_metrics(truth: Column, pred: Column) -> dict[str, Column]:
    """Edits and reference lengths of stripped lines, a blank one standing for nothing.

    A blank truth has no words, against which no rate can be taken: both rates are then 1
    where the lines differ and 0 where they do not, and edits and lengths say so.
    """
    t, p = blank_guard(truth), blank_guard(pred)
    return cleaned_metrics(t, p, tokens(t), tokens(p))


def cleaned_metrics(t: Column, p: Column, tw: Column, pw: Column) -> dict[str, Column]:
    """line_metrics() of lines that are stripped, and their words."""
    void = F.size(tw) == 0
    differ = (t != p).cast("int")
    return {
        "char_edits": F.when(void, differ).otherwise(char_edits(t, p)),
        "char_len": F.when(void, 1).otherwise(F.length(t)),
        "word_edits": F.when(void, differ).otherwise(token_edits(tw, pw)),
        "word_len": F.when(void, 1).otherwise(F.size(tw)),
    }


def cer(truth: Column, pred: Column) -> Column:
    m = line_metrics(truth, pred)
    return m["char_edits"] / m["char_len"]


def wer(truth: Column, pred: Column) -> Column:
    m = line_metrics(truth, pred)
    return m["word_edits"] / m["word_len"]
