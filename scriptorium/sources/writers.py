"""Writers: contracts, analyses, predictions, reports, comparisons, PAGE-XML, plot data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import contract, metrics

# Namespace and schema of PAGE-XML.
PAGE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"
XSI = "http://www.w3.org/2001/XMLSchema-instance"


def write_contracts(lines: DataFrame, path: str, *, images: DataFrame | None = None, validate: bool = True) -> None:
    """One JSON document a row; a broken rule stops the write."""
    contract.documents(contract.validated(lines).drop("violations") if validate else lines, images).write.mode("overwrite").json(path)


def analysis_json(analyses: DataFrame, *, at: Column | None = None, version: str = "1.0.0", tools: dict | None = None) -> DataFrame:
    """(document_id, json): an entity's label is its type there."""
    entities = F.transform("entities", lambda e: F.struct(e["text"].alias("text"), e["label"].alias("type"), e["start"].alias("start"), e["end"].alias("end"), e["source"].alias("source"), e["confidence"].alias("confidence")))
    used = F.struct(*(F.lit(bool(v)).alias(k) for k, v in (tools or {"spacy": False, "stanza": False, "sklearn": False}).items()))
    when = F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    whole = F.struct("document_id", "transcription", "normalized_text", "language", "confidence", entities.alias("entities"), "relations", "themes", F.struct(when.alias("processed_at"), F.lit(version).alias("pipeline_version"), used.alias("tools")).alias("metadata"))
    return analyses.select("document_id", F.to_json(whole).alias("json"))


def write_analyses(analyses: DataFrame, path: str, **options) -> None:
    analysis_json(analyses, **options).select("json").write.mode("overwrite").text(path)


def prediction_lines(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.concat_ws("\t", "img_name", F.coalesce("pred", F.lit(""))).alias("value"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    prediction_lines(predictions).write.mode("overwrite").text(path)


def evaluation_report(scored: DataFrame, *, model: str = "", model_type: str = "", checkpoint: str = "", lora_loaded: bool = False) -> DataFrame:
    """One row: cer, wer, accuracy, num_samples and what made the predictions."""
    fixed = {"model": model, "model_type": model_type, "checkpoint": checkpoint, "lora_loaded": lora_loaded}
    return metrics.micro(scored).select("cer", "wer", "accuracy", "num_samples", *(F.lit(v).alias(k) for k, v in fixed.items()))


def _percent(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100)


def comparison_text(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, section, ord, value): a document's comparison, line by line.

    lines: document_id, line_id, reading_order, route, ground_truth, text, cer, wer,
    confidence, bbox (text), reason. pages: document_id, cer_global, wer_global, has_truth.
    """
    rule, d = F.lit("=" * 80), F.col("document_id")
    n = lines.groupBy("document_id").agg(
        F.count_if(F.col("route") == "main").alias("n"), F.count_if((F.col("route") == "main") & (F.coalesce("ground_truth", F.lit("")) != "")).alias("aligned"), F.count_if(F.col("route") == "marginalia").alias("marg"), F.count_if(F.col("route") == "discarded").alias("gone")
    )
    head = pages.join(n, "document_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    numbers = F.array(
        F.concat(F.lit("CER global : "), _percent(F.col("cer_global"))), F.concat(F.lit("WER global : "), _percent(F.col("wer_global"))), F.concat(F.lit("Lignes transcrites : "), count("n")),
        F.concat(F.lit("Lignes GT alignées : "), count("aligned")), F.concat(F.lit("Marginalia détectées : "), count("marg")), F.concat(F.lit("Lignes rejetées : "), count("gone")), F.lit(""), rule, F.lit(""),
    )
    title = F.array(rule, F.lit("COMPARAISON GROUND TRUTH vs PRÉDICTION"), F.concat(F.lit("Document : "), d), rule, F.lit(""))
    top = head.select("document_id", F.lit(0).alias("section"), F.lit(0).alias("ord"), F.explode(F.concat(title, F.when(F.col("has_truth"), numbers).otherwise(F.array().cast("array<string>")))).alias("value"))
    truth = F.coalesce("ground_truth", F.lit("")) != ""
    said = F.array(
        F.format_string("--- %s (ro=%d) ---", "line_id", F.col("reading_order").cast("int")),
        F.when(truth, F.concat(F.lit("GT   : "), "ground_truth")),
        F.concat(F.lit("PRED : "), "text"),
        F.when(truth, F.concat(F.lit("CER  : "), _percent(F.col("cer")), F.lit(" | WER : "), _percent(F.col("wer")), F.format_string(" | CONF : %.2f", "confidence"))).otherwise(F.format_string("CONF : %.2f (sans GT)", "confidence")),
        F.lit(""),
    )
    pick = lambda route, section, value, order: lines.filter(F.col("route") == route).select("document_id", F.lit(section).alias("section"), order.cast("int").alias("ord"), F.explode(F.array_compact(value)).alias("value"))
    of_lines = pick("main", 1, said, F.col("reading_order"))
    place = F.coalesce("det_ord", F.lit(0)) if "det_ord" in lines.columns else F.lit(0)
    margins = pick("marginalia", 2, F.array(F.concat(F.lit("--- "), "line_id", F.lit(" ---")), F.concat(F.lit("BBOX : "), "bbox"), F.format_string("CONF : %.2f", "confidence"), F.lit("")), place)
    gone = pick("discarded", 3, F.array(F.concat(F.lit("Raison : "), "reason", F.lit(" | BBOX : "), "bbox")), place)
    return top.unionByName(of_lines).unionByName(margins).unionByName(gone)


def comparison_json(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """One nested row a document: information, metrics, lines, marginalia, discarded."""
    group = lambda route, *cols: F.sort_array(F.collect_list(F.when(F.col("route") == route, F.struct(*cols)))).alias({"main": "lines"}.get(route, route))
    nested = lines.groupBy("document_id").agg(
        group("main", "reading_order", "line_id", "ground_truth", F.col("text").alias("prediction"), "cer", "wer", "confidence", "needs_review", "region_type"),
        group("marginalia", "line_id", "bbox", "confidence"),
        group("discarded", "reason", "bbox", "height", "width"),
    )
    info = F.struct(F.size("lines").alias("num_lines_detected"), F.size("marginalia").alias("num_marginalia"), F.size("discarded").alias("num_discarded"), "line_count_alert").alias("segmentation_info")
    scores = F.struct("cer_global", "wer_global", "avg_confidence", "needs_review_rate", "cer_distribution").alias("metrics")
    return nested.join(pages, "document_id").select("document_id", F.col("has_truth").alias("has_ground_truth"), info, scores, "lines", "marginalia", "discarded")


def document_report(pages: DataFrame, analyses: DataFrame, most: int = 10) -> DataFrame:
    """One row a document: counts, scores and the first entities and relations of its analysis."""
    e = F.transform(F.slice("entities", 1, most), lambda x: F.struct(x["text"].alias("text"), x["label"].alias("type"), x["confidence"].alias("confidence")))
    r = F.transform(F.slice("relations", 1, most), lambda x: F.struct(x["subject"].alias("subject"), x["predicate"].alias("predicate"), x["object"].alias("object")))
    nlp = analyses.select("document_id", F.struct("language", F.size("entities").alias("num_entities"), F.size("relations").alias("num_relations"), "themes", "confidence", e.alias("entities"), r.alias("relations")).alias("nlp_results"))
    return pages.join(nlp, "document_id", "left").withColumn("nlp_available", F.col("nlp_results").isNotNull())


def final_document(pages: DataFrame, entries: DataFrame, analyses: DataFrame, texts: DataFrame, *, version: str = "2.2.0") -> DataFrame:
    """One nested row a document: report, full texts, contract lines."""
    lines = contract.documents(entries).select("document_id", "lines")
    return document_report(pages, analyses).join(texts, "document_id", "left").join(lines, "document_id", "left").withColumn("pipeline_version", F.lit(version))


def full_text(lines: DataFrame, column: str = "text", alias: str = "full_text") -> DataFrame:
    """(document_id, full_text): line texts joined by blanks, by reading order."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", F.coalesce(column, F.lit("")).alias("t")))), lambda x: x["t"]), " ")
    return lines.groupBy("document_id").agg(joined.alias(alias))


def segmentation_json(pages: DataFrame, lines: DataFrame, regions: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """One nested row a page: image, regions, lines by reading order, marginalia, discarded."""
    from ..operators import align

    rows = align.with_extracted_images(lines, extracted) if extracted is not None else lines.withColumn("extracted_image", F.lit(None).cast("string"))
    box = F.array("x0", "y0", "x1", "y1").alias("bbox")
    take = lambda route, name, *cols: F.sort_array(F.collect_list(F.when(F.col("route") == route, F.struct(*cols)))).alias(name)
    nested = rows.groupBy("page_id").agg(take("main", "lines", "reading_order", "line_id", box, "region_type", "conf", "extracted_image"), take("marginalia", "marginalia", "line_id", box, "conf"), take("discarded", "discarded", "det_ord", "reason", box, "height", "width"))
    areas = regions.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("region_id", "region_type", "polygon"))).alias("regions"))
    return pages.select("page_id", "image_path", F.array("img_h", "img_w").alias("image_shape"), F.lit(contract.COORDINATES).alias("system_coordinates")).join(areas, "page_id", "left").join(nested, "page_id", "left")


_SIGNS = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
_QUOTED = (*_SIGNS, ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;"))


def _attribute(x: Column) -> Column:
    for sign, name in _QUOTED:
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def _element(name: str, value: str) -> str:
    for sign, written in _SIGNS:
        value = value.replace(sign, written)
    return f"<{name}>{value}</{name}>" if value else f"<{name} />"


def page_xml(pages: DataFrame, *, creator: str = "scriptorium", created: str = "") -> DataFrame:
    """(page_id, xml) from nested pages: page_id, image_path, img_w, img_h, regions and marginalia.

    regions: [(region_id, region_type, polygon, lines: [(line_id, reading_order, polygon, baseline)])].
    What has no id or polygon is an error.
    """
    head = f'<?xml version="1.0" ?>\n<PcGts xmlns="{PAGE}" xmlns:xsi="{XSI}" xsi:schemaLocation="{PAGE} {PAGE}/pagecontent.xsd">\n  <Metadata>\n'
    head += f'    {_element("Creator", creator)}\n    {_element("Created", created)}\n  </Metadata>\n'
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    whole = lambda x: x.cast("bigint").cast("string")
    points = lambda p: F.array_join(F.transform(p, lambda q: said(whole(q[0]), ",", whole(q[1]))), " ")
    each = lambda rows, use: F.when(rows.isNull(), "").otherwise(F.array_join(F.transform(rows, use), ""))

    def line(x: Column, main: bool) -> Column:
        order = said(' readingOrder="', x["reading_order"].cast("string"), '"') if main else F.lit("")
        base = F.when(F.size(x["baseline"]) > 0, said('        <Baseline points="', points(x["baseline"]), '" />\n')).otherwise("") if main else F.lit("")
        made = said('      <TextLine id="', _attribute(x["line_id"]), '"', order, '>\n        <Coords points="', points(x["polygon"]), '" />\n', base, "      </TextLine>\n")
        return F.coalesce(made, F.raise_error(F.lit("page_xml: a line without id, place or polygon")))

    def region(x: Column) -> Column:
        start = said('    <TextRegion id="', _attribute(x["region_id"]), '" type="', _attribute(x["region_type"]), '">\n      <Coords points="', points(x["polygon"]), '" />\n')
        return F.coalesce(said(start, each(x["lines"], lambda r: line(r, True)), "    </TextRegion>\n"), F.raise_error(F.lit("page_xml: a region without id, type or polygon")))

    margin, name = F.col("marginalia"), F.element_at(F.split("image_path", "/"), -1)
    margins = F.when(F.size(margin) > 0, said('    <TextRegion id="', _attribute(F.col("page_id")), '_marginalia" type="marginalia">\n', each(margin, lambda r: line(r, False)), "    </TextRegion>\n")).otherwise("")
    inner = F.concat(each(F.col("regions"), region), margins)
    page = said('  <Page imageFilename="', _attribute(name), '" imageWidth="', F.col("img_w").cast("string"), '" imageHeight="', F.col("img_h").cast("string"), '"')
    xml = text.once(inner, lambda x: said(head, page, F.when(x == "", " />\n").otherwise(said(">\n", x, "  </Page>\n")), "</PcGts>\n"))
    return pages.select("page_id", F.coalesce(xml, F.raise_error(F.lit("page_xml: a page without id, image or size"))).alias("xml"))


def write_label_files(split_rows: DataFrame, path: str) -> None:
    """Label lines by split, one folder a split."""
    split_rows.select("split", F.concat_ws("\t", "img_name", "text").alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_images(images: DataFrame, path: str) -> None:
    """(name, content): pages or crops (page_id or line_id, height, width, pixels) as PNG files' bytes, in a table."""
    import numpy as np

    from ..operators import image

    key = "line_id" if "line_id" in images.columns else "page_id"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"name": pdf[key] + ".png", "content": [image.png(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)) for r in pdf.itertuples()]})

    images.select(key, "height", "width", "pixels").mapInPandas(run, "name string, content binary").write.mode("overwrite").parquet(path)


def best_config(runs: DataFrame, metric: str = "cer") -> DataFrame:
    """(json): the settings of the best run."""
    best = metrics.best_run(runs, metric)
    return best.select(F.to_json(F.struct(*best.columns)).alias("json"))


def training_history(history: DataFrame) -> DataFrame:
    """(run, json): each run's series, epoch by epoch."""
    row = F.struct("epoch", *(c for c in history.columns if c not in ("run", "epoch")))
    return history.groupBy("run").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("json"))


def error_curve(scored: DataFrame, column: str = "cer") -> DataFrame:
    """(place, value): values in ascending order, for a curve; places begin with 1.

    Equal values are counted first, so errors are measured once and only counts are dealt
    out; places come from the counts by steps of a hundredth.
    """
    counted = scored.select(F.col(column).alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    # never null, or a filter for the join comes below one of its sides, which then is not the other's exchange again
    counted = counted.withColumn("step", F.coalesce(F.floor(F.col("value") * 100), F.lit(0)))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = counted.groupBy("step").agg(F.sum("n").alias("n")).select("step", before(Window.orderBy("step")).alias("start"))  # one row a step
    placed = counted.withColumn("inside", before(Window.partitionBy("step").orderBy("value"))).join(steps, "step")
    return placed.select(F.explode(F.sequence(F.col("start") + F.col("inside") + 1, F.col("start") + F.col("inside") + F.col("n"))).alias("place"), "value")


def training_curves(history: DataFrame) -> DataFrame:
    """History by run and epoch, with the mark of each run's best epoch."""
    best = metrics.best_epoch(history, "run").select("run", F.col("epoch").alias("best_epoch"))
    return history.join(best, "run").withColumn("is_best", F.col("epoch") == F.col("best_epoch")).drop("best_epoch")


def prediction_grid(predictions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n predictions chosen by hash, with their error and its colour."""
    from ..operators import corpus

    return corpus.random_rows(predictions, n, "img_name", seed).withColumn("cer", metrics.swapped_cer(F.col("truth"), F.col("pred"))).withColumn("colour", text.title_colour(F.col("cer")))
