"""The line contract: building, checking, nesting, merging, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import corpus

# Allowed values of the contract.
REGION_TYPES = ("main_text", "marginalia", "heading", "illustration", "unknown")
COORDINATES, GEOMETRY, UNIT, MODEL = "origin_top_left", "Polygon", "pixels", "trocr-lora-v1"

#: Contracts whose lines of one place are numbered together.
CONTRACTS = 4096

LINE = ["line_id", "transcription", "confidence", "geometry", "needs_review", "reading_order", "region_type", "model_version"]


def valid_polygon(p: Column) -> Column:
    """At least three points of two integers each."""
    return F.coalesce((F.size(p) >= 3) & F.forall(p, lambda q: (F.size(q) == 2) & F.forall(q, lambda v: v.isNotNull())), F.lit(False))


def contract_lines(lines: DataFrame, *, threshold: float = 0.80, model: str = MODEL, strict: bool = True) -> DataFrame:
    """Contract lines from (document_id, line_id, text, confidence, polygon, reading_order, region_type).

    strict: a bad polygon is an error; otherwise the row stays with `rejected` true.
    """
    good = valid_polygon(F.col("polygon"))
    polygon = F.when(good, F.col("polygon")).otherwise(F.raise_error(F.lit("a polygon needs at least 3 points [int, int]"))) if strict else F.col("polygon")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    geometry = F.struct(F.lit(GEOMETRY).alias("type"), polygon.alias("coordinates"), F.lit(UNIT).alias("unit"))
    out = lines.select(
        "document_id",
        "line_id",
        text.strip(F.coalesce("text", F.lit(""))).alias("transcription"),
        F.round(clamped, 4).alias("confidence"),
        geometry.alias("geometry"),
        text.needs_review(F.col("text"), clamped, threshold).alias("needs_review"),
        F.coalesce("reading_order", F.lit(0)).alias("reading_order"),
        F.coalesce("region_type", F.lit("main_text")).alias("region_type"),
        F.lit(model).alias("model_version"),
        *([] if strict else [(~good).alias("rejected")]),
    )
    return out


def violations(line: str | None = None) -> Column:
    """Names of the rules that a contract line breaks."""
    c = lambda n: F.col(f"{line}.{n}" if line else n)
    g = c("geometry")
    missing = lambda x: x.isNull()
    rules = {
        "line_id missing": missing(c("line_id")),
        "transcription missing": missing(c("transcription")),
        "confidence missing": missing(c("confidence")),
        "confidence outside 0..1": ~c("confidence").between(0.0, 1.0) | F.isnan(c("confidence")),
        "geometry missing": missing(g),
        "geometry type": g.isNotNull() & ~F.coalesce(g["type"] == GEOMETRY, F.lit(False)),
        "geometry unit": g.isNotNull() & ~F.coalesce(g["unit"] == UNIT, F.lit(False)),
        "geometry coordinates": g.isNotNull() & ~valid_polygon(g["coordinates"]),
        "needs_review missing": missing(c("needs_review")),
        "reading_order negative": c("reading_order") < 0,
        "region_type unknown": ~c("region_type").isin(*REGION_TYPES),
    }
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())


def validated(contract: DataFrame, *, strict: bool = True) -> DataFrame:
    """Lines with their violations; strict: any is an error when the row is read."""
    out = contract.withColumn("violations", violations())
    if not strict:
        return out
    checked = F.when(F.size("violations") == 0, F.col("line_id")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("contract:"), F.col("line_id"), F.array_join("violations", "; "))))
    return out.withColumn("line_id", checked)


def documents(contract: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Nested documents, their lines by reading order."""
    present = [c for c in LINE if c in contract.columns]
    line = F.struct("reading_order", "line_id", F.struct(*present).alias("line"))
    out = contract.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    out = out.select("document_id", F.lit(COORDINATES).alias("system_coordinates"), "lines")
    return out if images is None else out.join(images.select("document_id", "image_path"), "document_id", "left")


def lines_of(nested: DataFrame) -> DataFrame:
    """One row a line of nested documents, with its place in the document."""
    return nested.select("document_id", F.posexplode("lines").alias("line_ord", "line")).select("document_id", "line_ord", "line.*")


def merge(contract: DataFrame, merged_id: str, *, contract_ord: str = "contract_ord", line_ord: str = "line_ord", strict_pages: bool = False) -> DataFrame:
    """Lines of several contracts as one document, numbered anew.

    Lines of different pages interleave by reading order, as contracts are listed;
    strict_pages keeps each page together. Lines are numbered by contract, or by place and
    a range of contracts, so no task holds them all.
    """
    near = F.floor(F.col(contract_ord) / CONTRACTS)
    chunk = {"__a": F.col(contract_ord)} if strict_pages else {"__a": F.col("reading_order"), "__b": near}
    keys = [contract_ord, "reading_order", line_ord] if strict_pages else ["reading_order", contract_ord, line_ord]
    return corpus.ranked(contract, chunk, keys, "__rank").withColumns({"reading_order": F.col("__rank").cast("int"), "document_id": F.lit(merged_id)}).drop("__rank")


def review_summary(contract: DataFrame, *by: str) -> DataFrame:
    """(total_lines, needs_review_count, needs_review_rate, avg_confidence)."""
    n, bad = F.count("*"), F.count_if("needs_review")
    return contract.groupBy(*by).agg(n.alias("total_lines"), bad.alias("needs_review_count"), F.coalesce(bad / n, F.lit(0.0)).alias("needs_review_rate"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))


def stats(contract: DataFrame) -> DataFrame:
    """Statistics of each document: review, confidence, distributions of regions and confidences."""
    kinds = contract.groupBy("document_id", F.coalesce("region_type", F.lit("unknown")).alias("k")).agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("region_distribution"))
    names = [name for _, name in text.CONFIDENCE_BUCKETS] + [">=0.9"]
    buckets = F.create_map(*(x for b in names for x in (F.lit(b), F.count_if(text.confidence_bucket(F.col("confidence")) == b))))
    main = contract.groupBy("document_id").agg(
        F.count("*").alias("total_lines"), F.count_if("needs_review").alias("needs_review_count"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), buckets.alias("confidence_distribution")
    )
    rate = F.col("needs_review_count") / F.col("total_lines")
    return main.join(kinds, "document_id").withColumns({"needs_review_rate": rate, "validated_rate": 1 - rate})
