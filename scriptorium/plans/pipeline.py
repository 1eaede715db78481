"""Whole pipelines: page to document, text to analyses and report, predictions to evaluation, corpus to splits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import stages
from ..functions import text
from ..operators import align, contract, corpus, image, layout, metrics, nlp
from ..sources import readers, writers

THRESHOLD, THRESHOLD_WITH_TRUTH = 0.80, 0.70
MISSING_IMAGE = "[IMAGE_MANQUANTE]"


@dataclass
class PipelineConfig:
    """Options of run_pipeline; a transcriber of None stands for the mock."""

    seg_method: str = "kraken"
    segmenter: Callable | None = None
    transcriber: Callable | None = None
    skip_preprocessing: bool = False
    skip_nlp: bool = False
    taggers: list = field(default_factory=list)
    parser: object = None
    rules: bool = True
    binarise: bool = False
    strict: bool = True


def run_pipeline(pages: DataFrame, config: PipelineConfig | None = None, truth: DataFrame | None = None) -> dict[str, DataFrame]:
    """From page images (page_id, height, width, pixels) to lines, entries, pages, comparisons and analyses.

    Everything is lazy; each result is a frame of its own and takes only what it needs.
    """
    config = config or PipelineConfig()
    if config.seg_method not in stages.METHODS:
        raise ValueError(f"unknown method: {config.seg_method}")
    ready = pages if config.skip_preprocessing else image.mapped(pages, image.prepare, binarise=config.binarise)
    method = "lines" if config.seg_method == "kraken" else "boxes"
    boxes = stages.segment(ready, config.segmenter or stages.bands())
    routed = layout.number(layout.route(boxes, method), method)
    main = layout.reading_order(routed.filter("route = 'main'"), centre=method == "boxes").withColumn("document_id", F.col("page_id"))
    if config.transcriber:
        crops = image.line_crops(ready, main)
        read = stages.transcribe(crops.select("page_id", "line_id", "pixels"), config.transcriber).select("page_id", "line_id", "text")
        said = main.join(read, ["page_id", "line_id"], "left").withColumn("image_found", F.col("text").isNotNull()).withColumn("text", F.coalesce("text", F.lit(MISSING_IMAGE)))
    else:
        said = stages.mock_transcribe(main).withColumn("image_found", F.lit(True))
    have = truth is not None
    scored = score_lines(said, truth, mock=config.transcriber is None)
    scored = scored.withColumn("polygon", layout.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    entries = contract.contract_lines(scored, threshold=THRESHOLD_WITH_TRUTH if have else THRESHOLD, strict=config.strict)
    flagged = align.review_flags(scored, entries)
    box = F.format_string("(%d, %d, %d, %d)", "x0", "y0", "x1", "y1")
    aside = routed.filter("route <> 'main'").withColumn("document_id", F.col("page_id"))
    every = flagged.withColumn("bbox", box).unionByName(aside.withColumn("bbox", box), allowMissingColumns=True).withColumn("confidence", F.coalesce("confidence", "conf"))
    summary = page_summary(scored, entries, every, truth, have)
    out = {"boxes": routed, "lines": scored, "entries": entries, "comparison_lines": every, "pages": summary, "comparison_text": writers.comparison_text(every, summary), "comparison": writers.comparison_json(every, summary)}
    if not config.skip_nlp:
        whole = writers.full_text(scored)
        out["analyses"] = nlp.analyse(whole, text_col="full_text", taggers=config.taggers, rules=config.rules, parser=config.parser)
        out["report"] = writers.document_report(summary, out["analyses"])
        out["final"] = writers.final_document(summary, entries, out["analyses"], whole)
    return out


def score_lines(lines: DataFrame, truth: DataFrame | None, *, mock: bool = False) -> DataFrame:
    """Adds ground_truth, cer, wer and confidence to lines with text, conf and image_found."""
    if truth is None:
        out = lines.withColumns({"ground_truth": F.lit(""), "cer": F.lit(0.0), "wer": F.lit(0.0)})
        return out if mock else out.withColumn("confidence", text.line_confidence(F.lit(False), F.lit(0.0), F.col("text"), F.col("conf"), F.col("image_found")))
    met = metrics.with_metrics(align.align(lines, truth).withColumn("ground_truth", F.coalesce("ground_truth", F.lit(""))))
    has, found = F.col("ground_truth") != "", F.col("image_found")
    met = met.withColumns({m: F.when(~found, 1.0).when(has, F.col(m)).otherwise(0.0) for m in ("cer", "wer")})
    return met if mock else met.withColumn("confidence", text.line_confidence(has, F.col("cer"), F.col("text"), F.col("conf"), found))


def page_summary(scored: DataFrame, entries: DataFrame, every: DataFrame, truth: DataFrame | None, have: bool) -> DataFrame:
    """One row a document: rates, confidence, review, buckets, counts, the alert of lines that are missing."""
    rates = metrics.macro(scored, "document_id").join(metrics.bucket_counts(scored.filter("ground_truth <> ''"), "document_id"), "document_id", "left")
    buckets = F.create_map(*(x for b in metrics.BUCKETS for x in (F.lit(b), F.coalesce(b, F.lit(0)))))
    rates = rates.withColumn("cer_distribution", buckets).drop(*metrics.BUCKETS)
    counts = every.groupBy("document_id").agg(*(F.count_if(F.col("route") == r).alias(f"n_{r}") for r in ("main", "marginalia", "discarded")))
    out = counts.join(rates, "document_id", "left").join(contract.review_summary(entries, "document_id"), "document_id", "left").withColumn("has_truth", F.lit(have))
    if not have:
        return out.withColumn("line_count_alert", F.lit(False))
    expected = truth.groupBy("document_id").agg(F.count("*").alias("n_truth"))
    return out.join(expected, "document_id", "left").withColumn("line_count_alert", text.count_alert(F.coalesce("n_truth", F.lit(0)), F.col("n_main")))


def analyse_path(spark: SparkSession, path: str, *, batch: bool = False, **options) -> dict[str, DataFrame]:
    """Analyses and report of a file of transcriptions, or of all prediction files below a folder."""
    rows = readers.discover(spark, path) if batch else readers.predictions(spark, path)
    found = nlp.analyse(rows, id_col="id", text_col="text", **options)
    return {"analyses": found, "report": nlp.report_document(found), "summaries": nlp.document_summaries(found)}


def analyse_text(spark: SparkSession, value: str, **options) -> DataFrame:
    return nlp.analyse(spark.createDataFrame([("text", value)], "document_id string, transcription string"), **options)


def evaluate(predictions: DataFrame, truth: DataFrame, **about) -> dict[str, DataFrame]:
    """Report, scored lines and error histogram of predictions (img_name, pred) against truths (img_name, text)."""
    pairs = align.with_predictions(truth.select("img_name", F.col("text").alias("ground_truth")), predictions.select("img_name", "pred"))
    scored = metrics.with_metrics(pairs, "ground_truth", "pred")
    swapped = scored.select("img_name", metrics.swapped_cer(F.col("ground_truth"), F.col("pred")).alias("cer"))
    return {"report": writers.evaluation_report(scored, **about), "lines": scored, "histogram": metrics.histogram(swapped, "cer"), "curve": writers.error_curve(swapped)}


def split_corpus(rows: DataFrame, *, key: str, text_col: str = "text", total: int | None = 400, filter_old_french: bool = False, seed: int = 42) -> DataFrame:
    return corpus.split(rows, key=key, text_col=text_col, total=total, old_french_only=filter_old_french, seed=seed)
