"""Contracts of model-backed stages, and stand-ins that need no model.

A segmenter turns pages into boxes, a transcriber line images into texts, a tagger texts
into entities. Bring a model by giving a function that each Python worker calls once to
load it and then for every batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text
from .operators import nlp

BOXES = "page_id string, det_ord int, x0 int, y0 int, x1 int, y1 int, img_w int, img_h int, tag string, conf double"
METHODS = ("kraken", "yolo")


def segment(pages: DataFrame, load: Callable[[], Callable[[np.ndarray], list[tuple]]]) -> DataFrame:
    """Boxes of pages (page_id, height, width, pixels): the model gives (x0, y0, x1, y1, tag, confidence) in order of detection."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                page = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)
                rows += [(r.page_id, i, *map(int, b[:4]), r.width, r.height, b[4], float(b[5])) for i, b in enumerate(model(page))]
            yield pd.DataFrame(rows, columns=["page_id", "det_ord", "x0", "y0", "x1", "y1", "img_w", "img_h", "tag", "conf"])

    return pages.select("page_id", "height", "width", "pixels").mapInPandas(run, BOXES)


def bands(least: int = 15, dark: int = 128) -> Callable[[], Callable[[np.ndarray], list[tuple]]]:
    """A segmenter without a model: runs of rows with ink are lines."""

    def load():
        def model(page: np.ndarray) -> list[tuple]:
            ink = page < dark
            rows = np.concatenate([[False], ink.any(1), [False]])
            edges = np.flatnonzero(rows[1:] != rows[:-1]).reshape(-1, 2)
            out = []
            for y0, y1 in edges.tolist():
                if y1 - y0 >= least:
                    cols = np.flatnonzero(ink[y0:y1].any(0))
                    out.append((cols[0], y0, cols[-1] + 1, y1, "default", 0.9))
            return out

        return model

    return load


def transcribe(crops: DataFrame, load: Callable[[], Callable[[list[bytes]], list[str]]]) -> DataFrame:
    """Adds text to line images (..., pixels): the model reads a batch at a time."""
    out = T.StructType([*crops.schema.fields, T.StructField("text", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            yield pdf.assign(text=model(list(pdf.pixels)))

    return crops.mapInPandas(run, out)


def mock_transcribe(lines: DataFrame) -> DataFrame:
    """Adds text and confidence that only depend on a line's place and id."""
    return lines.withColumns({"text": text.mock_transcription(F.col("reading_order")), "confidence": text.mock_confidence(F.col("line_id"))})


def tagger(load: Callable[[], Callable[[str], list[tuple]]], source: str, *, labels: dict[str, str] | None = None, confidence: Callable[[str], float] = lambda label: 0.80):
    """A pandas UDF from text to entities: the model gives (text, label, start, end)."""
    names, kind = labels or {}, nlp.ENTITY

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for x in parts:
            yield x.map(lambda s: [{"text": t, "label": (k := names.get(label, label)), "start": a, "end": b, "source": source, "confidence": confidence(k)} for t, label, a, b in model(s or "")])

    return run


# Labels and confidences of the two usual kinds of taggers.
SPACY_LABELS = {"PER": "PER", "PERSON": "PER", "LOC": "LOC", "GPE": "LOC", "ORG": "ORG", "DATE": "DATE", "MONEY": "MONEY"}


def spacy_confidence(label: str) -> float:
    return 0.75 if label in ("PER", "LOC") else 0.65


def parser(load: Callable[[], Callable[[str], list[tuple]]]):
    """A pandas UDF from text to relations: the model gives (subject, object, sentence) of verbs of giving."""
    kind = nlp.RELATION

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for x in parts:
            yield x.map(lambda s: [{"subject": a, "predicate": "donne_à", "object": b, "sentence": c, "confidence": 0.70} for a, b, c in model(s or "") if len(a) > 2 and len(b) > 2])

    return run
