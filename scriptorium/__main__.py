"""Command lines: python -m scriptorium page|analyse|evaluate|split ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .plans import pipeline
from .sources import readers, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scriptorium")
    kinds = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *options: tuple) -> None:
        sub = kinds.add_parser(name, help=about)
        for flags, settings in options:
            sub.add_argument(*flags, **settings)

    yes = {"action": "store_true"}
    output = (("--output", "-o"), {"default": "./results"})
    command(
        "page", "page images to lines, contracts, comparisons and analyses",
        (("--images", "-i"), {"required": True}), output, (("--seg-method",), {"default": "kraken"}), (("--ground-truth", "-g"), {}),
        (("--id",), {"help": "the page that the ground truth is of"}), (("--skip-preprocessing",), yes), (("--skip-nlp",), yes), (("--binarise",), yes),
    )
    command("analyse", "transcriptions to entities, relations, themes and a report", (("--input", "-i"), {}), (("--text", "-t"), {}), output, (("--batch",), yes), (("--no-rules",), yes))
    command("evaluate", "predictions against labels", (("--predictions", "-p"), {"required": True}), (("--labels", "-l"), {"required": True}), output, (("--model",), {"default": ""}))
    command("split", "a corpus into train, dev and test labels", (("--input", "-i"), {"required": True}), output, (("--key",), {"default": "id"}), (("--text-col",), {"default": "text"}), (("--total-lines",), {"type": int}), (("--filter-old-french",), yes), (("--seed",), {"type": int, "default": 42}))
    return top


def _json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def page(spark: SparkSession, a: argparse.Namespace) -> None:
    truth = readers.ground_truth(spark, a.ground_truth)
    pages = readers.images(spark, a.images)
    if truth is not None:
        from pyspark.sql import functions as F

        truth = truth.withColumn("document_id", F.lit(a.id) if a.id else F.lit(pages.first().page_id))
    out = pipeline.run_pipeline(pages, pipeline.PipelineConfig(seg_method=a.seg_method, skip_preprocessing=a.skip_preprocessing, skip_nlp=a.skip_nlp, binarise=a.binarise), truth)
    writers.write_contracts(out["entries"], f"{a.output}/contracts")
    _json(out["comparison"], f"{a.output}/comparison")
    out["comparison_text"].orderBy("document_id", "section", "ord").select("value").write.mode("overwrite").text(f"{a.output}/comparison_text")
    if not a.skip_nlp:
        writers.write_analyses(out["analyses"], f"{a.output}/analyses")
        _json(out["report"], f"{a.output}/report")
        _json(out["final"], f"{a.output}/documents")


def analyse(spark: SparkSession, a: argparse.Namespace) -> None:
    if (a.text is None) == (a.input is None):
        raise SystemExit("either --input or --text")
    if a.text is not None:
        writers.analysis_json(pipeline.analyse_text(spark, a.text, rules=not a.no_rules)).select("json").show(truncate=False)
        return
    out = pipeline.analyse_path(spark, a.input, batch=a.batch, rules=not a.no_rules)
    writers.write_analyses(out["analyses"], f"{a.output}/analyses")
    _json(out["report"], f"{a.output}/corpus_report")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    predictions = readers.predictions(spark, a.predictions).selectExpr("id || '.png' as img_name", "text as pred")
    out = pipeline.evaluate(predictions, readers.labels(spark, a.labels).select("img_name", "text"), model=a.model)
    for name in ("report", "histogram"):
        _json(out[name], f"{a.output}/{name}")
    out["report"].show(truncate=False)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.corpus_rows(spark, a.input)
    writers.write_label_files(pipeline.split_corpus(rows, key=a.key, text_col=a.text_col, total=a.total_lines, filter_old_french=a.filter_old_french, seed=a.seed).withColumnRenamed(a.text_col, "text"), a.output)


COMMANDS = {"page": page, "analyse": analyse, "evaluate": evaluate, "split": split}


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    COMMANDS[a.command](SparkSession.builder.appName("scriptorium").getOrCreate(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
