"""Streams: analyses of arriving documents, and review rates over time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nlp


def documents(spark: SparkSession, folder: str, schema: str = "document_id string, transcription string", *, files_per_trigger: int = 64, kind: str = "json") -> DataFrame:
    """Documents as files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(folder)


def analyses(stream: DataFrame, **options) -> DataFrame:
    """Each document's analysis by itself: no state, any output mode."""
    return nlp.analyse(stream, **options)


def review_rate(lines: DataFrame, *, time: str = "ts", window: Column | None = None, late: str = "10 minutes", every: str = "1 hour", slide: str | None = None, gap: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, window_start, window_end, lines, reviews) over tumbling, sliding or session windows.

    Sessions of a stream need a key in `by`, whose sessions they are.

    State is two counts a window, dropped when the watermark has passed it. Times without a
    zone are taken as UTC.
    """
    timed = lines.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = window if window is not None else F.session_window(time, gap) if gap else F.window(time, every, slide or every)
    out = timed.groupBy(*by, w.alias("w")).agg(F.count("*").alias("lines"), F.count_if("needs_review").alias("reviews"))
    return out.select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "lines", "reviews")
