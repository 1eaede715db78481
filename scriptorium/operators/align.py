"""Alignment of lines with reference transcriptions, and other lookups by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align(lines: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds ground_truth to (document_id, line_id, reading_order).

    truth: (document_id, line_id, text, ord), line ids unique in a document. First by id:
    the line's own, then with the document's prefix, then without it. Where fewer than half
    of a document's lines are met so, the others take the truth of their place instead.

    One exchange by document serves the three lookups and the numbering.
    """
    t = truth.select("document_id", F.col("line_id").alias("gt_id"), F.col("text").alias("gt"), "ord")
    prefix = F.concat("document_id", F.lit("_"))
    tries = [F.col("line_id"), F.concat(prefix, "line_id"), F.when(F.startswith("line_id", prefix), F.expr("substring(line_id, length(document_id) + 2)"))]
    keyed = lines.withColumn("__try", F.explode(F.filter(F.array(*(F.struct(F.lit(i).alias("rank"), k.alias("id")) for i, k in enumerate(tries))), lambda x: x["id"].isNotNull())))
    hits = keyed.join(t, (keyed.document_id == t.document_id) & (F.col("__try.id") == t.gt_id)).select(keyed.document_id, "line_id", "reading_order", F.col("__try.rank").alias("rank"), "gt")
    first = hits.groupBy("document_id", "line_id", "reading_order").agg(F.min_by("gt", "rank").alias("by_id"))
    met = lines.join(first, ["document_id", "line_id", "reading_order"], "left")

    by_doc = Window.partitionBy("document_id")
    place = by_doc.orderBy("reading_order", "line_id")
    # an order counts as met once, and a line takes what its order has
    of_order = Window.partitionBy("document_id", "reading_order").orderBy(F.col("by_id").isNull(), "line_id")
    met = met.withColumns({"__met": F.size(F.collect_set(F.when(F.col("by_id").isNotNull(), F.col("reading_order"))).over(by_doc)), "__lines": F.count("*").over(by_doc), "__place": F.row_number().over(place), "__of_order": F.first("by_id").over(of_order)})
    values = t.select("document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("ord")).alias("__place"), F.col("gt").alias("by_place"))
    placed = met.join(values, ["document_id", "__place"], "left")
    chosen = F.coalesce("__of_order", F.when(F.col("__met") < F.col("__lines") * 0.5, F.col("by_place")))
    return placed.select(*(placed[c] for c in lines.columns), chosen.alias("ground_truth"))


def with_predictions(truth: DataFrame, predictions: DataFrame, key: str = "img_name") -> DataFrame:
    """Truths with the prediction of the same name, where there is one."""
    return truth.join(predictions, key)


def review_flags(transcriptions: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds needs_review: whether any entry of the line needs review."""
    flags = entries.groupBy("document_id", "line_id").agg(F.bool_or("needs_review").alias("needs_review"))
    return transcriptions.join(flags, ["document_id", "line_id"], "left").withColumn("needs_review", F.coalesce("needs_review", F.lit(False)))


def with_extracted_images(lines: DataFrame, extracted: DataFrame) -> DataFrame:
    """Adds extracted_image by line id; of several, the first."""
    paths = extracted.groupBy("line_id").agg(F.min("img_path").alias("extracted_image"))
    return lines.join(paths, "line_id", "left")


def calibrate(scored: DataFrame, table: DataFrame) -> DataFrame:
    """Adds confidence from a table of half-open ranges (low, high, confidence); 0.10 outside all.

    The table is the calibration, a handful of rows; sorted, it is one array, so no range
    join is made for each row.
    """
    ranges = table.agg(F.sort_array(F.collect_list(F.struct("low", "high", "confidence"))).alias("__ranges"))
    hit = F.filter("__ranges", lambda r: (r["low"] <= F.col("cer")) & (F.col("cer") < r["high"]))
    return scored.crossJoin(F.broadcast(ranges)).withColumn("confidence", F.coalesce(F.get(hit, F.lit(0))["confidence"], F.lit(0.10))).drop("__ranges")  # one row on the right
