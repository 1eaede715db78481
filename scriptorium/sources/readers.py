"""Readers: label files, predictions, references, contracts, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

TODO = "[TODO_TRANSCRIPTION]"
# Files of the splits.
SPLITS = {"train": "train.txt", "dev": "dev.txt", "test": "test.txt"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def numbered_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, line_no, value): lines numbered in their file from 0, blank ones counted.

    A text file is read whole, since only so are its lines numbered; such files hold one
    page's or one split's labels.
    """
    whole = spark.read.options(**options).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line_no", "value"))


def labels(spark: SparkSession, path: str, image_dir: str = "") -> DataFrame:
    """(img_name, text, img_path, line_no) of lines with a TAB; no rows where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "img_name string, text string, img_path string, line_no int")
    rows = numbered_lines(spark, path).withColumn("value", text.strip(F.col("value"))).filter(F.contains("value", F.lit("\t")))
    parts = F.split("value", "\t", 2)
    return rows.select(parts[0].alias("img_name"), parts[1].alias("text"), F.concat(F.lit(image_dir.rstrip("/") + "/" if image_dir else ""), parts[0]).alias("img_path"), "line_no")


def training_labels(spark: SparkSession, path: str, image_dir: str = "") -> DataFrame:
    return labels(spark, path, image_dir).filter(~F.contains("text", F.lit(TODO)))


def split_path(directory: str, split: str) -> str:
    return f"{directory.rstrip('/')}/{SPLITS.get(split, SPLITS['dev'])}"


def last_wins(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows with equal keys the text of the last, at the place of the first."""
    return rows.groupBy(*keys).agg(F.max_by("text", "ord").alias("text"), F.min("ord").alias("ord"))


def _from_text(lines: DataFrame, default: str) -> DataFrame:
    value = text.strip(F.col("value"))
    parts = F.split(value, "\t", 2)
    tab = F.contains(value, F.lit("\t"))
    name = F.when(tab, text.without_image_suffix(parts[0])).otherwise(F.concat(F.lit(default), F.lpad(F.col("line_no").cast("string"), 4, "0")))
    return lines.filter(value != "").select("file", name.alias("id"), F.when(tab, parts[1]).otherwise(value).alias("text"), F.col("line_no").alias("ord"))


_ITEM = "struct<img_name:string,document_id:string,line_id:string,pred:string,transcription:string,text:string>"


def _json(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def _pairs(body: Column) -> Column:
    return F.from_json(body, "map<string,string>")


def texts(spark: SparkSession, path: str, *, ids: tuple = ("img_name", "document_id"), values: tuple = ("pred", "transcription", "text"), **options) -> DataFrame:
    """(file, id, text, ord): transcriptions from JSON (a list of records, or a map) or lines of text.

    In a record the first present of ids and of values counts; without an id it is doc_n by
    its place. The last of equal ids wins.
    """
    if not path.endswith(".json"):
        return last_wins(_from_text(numbered_lines(spark, path, **options), "doc_"), "file", "id")
    body = _json(spark, path, **options)
    listed = body.filter(F.ltrim("body").startswith("[")).select("file", F.posexplode(F.from_json("body", f"array<{_ITEM}>")).alias("ord", "r"))
    rows = listed.select("file", F.coalesce(*(F.col(f"r.{k}") for k in ids), F.concat(F.lit("doc_"), F.col("ord").cast("string"))).alias("id"), F.coalesce(*(F.col(f"r.{k}") for k in values), F.lit("")).alias("text"), "ord")
    keyed = body.filter(F.ltrim("body").startswith("{")).select("file", F.posexplode(F.map_entries(_pairs(F.col("body")))).alias("ord", "e")).select("file", F.col("e.key").alias("id"), F.col("e.value").alias("text"), "ord")
    return last_wins(rows.unionByName(keyed), "file", "id")


def predictions(spark: SparkSession, path: str, **options) -> DataFrame:
    return texts(spark, path, **options)


def transcriptions(spark: SparkSession, path: str, **options) -> DataFrame:
    """As predictions, with the document's own id first and no `pred`."""
    return texts(spark, path, ids=("document_id", "img_name"), values=("transcription", "text"), **options)


def ground_truth(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(line_id, text, ord), None without a path or file. A JSON list holds no truth."""
    if not path or not exists(spark, path):
        return None
    if not path.endswith(".json"):
        return last_wins(_from_text(numbered_lines(spark, path), "line_"), "id").withColumnRenamed("id", "line_id")
    body = _json(spark, path).filter(F.ltrim("body").startswith("{"))
    records = body.select(F.posexplode(F.from_json(F.get_json_object("body", "$.lines"), f"array<{_ITEM}>")).alias("ord", "r"))
    rows = records.select(F.coalesce("r.line_id", F.concat(F.lit("line_"), F.lpad(F.col("ord").cast("string"), 4, "0"))).alias("id"), F.coalesce("r.text", "r.transcription", F.lit("")).alias("text"), "ord")
    plain = body.filter(F.get_json_object("body", "$.lines").isNull()).select(F.posexplode(F.map_entries(_pairs(F.col("body")))).alias("ord", "e")).select(F.col("e.key").alias("id"), F.col("e.value").alias("text"), "ord")
    return last_wins(rows.unionByName(plain), "id").withColumnRenamed("id", "line_id")


def by_shelfmark(spark: SparkSession, shelfmark: str, directory: str) -> DataFrame | None:
    """Lines of train, dev and test whose image name holds the mark, in any case; None where there are none."""
    found = None
    for i, s in enumerate(SPLITS):
        part = labels(spark, split_path(directory, s)).withColumn("split_ord", F.lit(i))
        found = part if found is None else found.unionByName(part)
    found = found.filter(F.contains(F.lower("img_name"), F.lower(F.lit(shelfmark))))
    return None if found.isEmpty() else found


def discover(spark: SparkSession, root: str, name: str = "predictions.txt") -> DataFrame:
    """(file, id, text, ord, subdir) of all files of this name below a folder; subdir: their folder, joined by _."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": name}
    rows = last_wins(_from_text(numbered_lines(spark, root, **options), "doc_"), "file", "id")
    base = root.split(":", 1)[-1].strip("/")
    inner = F.regexp_extract("file", f"{base}/(.*)/[^/]*$", 1)
    return rows.withColumn("subdir", F.when(inner == "", "default").otherwise(F.replace(inner, F.lit("/"), F.lit("_"))))


_LINE = (
    "line_id:string,transcription:string,confidence:double,geometry:struct<type:string,coordinates:array<array<int>>,unit:string>,"
    "needs_review:boolean,reading_order:int,region_type:string,model_version:string"
)
CONTRACT = f"document_id string, system_coordinates string, image_path string, lines array<struct<{_LINE}>>"


def contracts(spark: SparkSession, paths: str | list[str], *, strict: bool = True, multi_line: bool = True) -> DataFrame:
    """One row a contract line: (document_id, contract_ord, line_ord, ...), checked as on writing.

    multi_line: a file is one contract; else each line of a file is one, as write_contracts() makes them.
    """
    from ..operators import contract

    rows = spark.read.schema(CONTRACT).json(paths, multiLine=multi_line).withColumn("file", F.col("_metadata.file_path"))
    listed = [paths] if isinstance(paths, str) else list(paths)
    order = F.coalesce(*(F.when(F.endswith("file", F.lit(p.split(":", 1)[-1].lstrip("/"))), i) for i, p in enumerate(listed)), F.lit(0))
    lines = rows.withColumn("contract_ord", order).select("document_id", "contract_ord", F.posexplode("lines").alias("line_ord", "line")).select("document_id", "contract_ord", "line_ord", "line.*")
    return contract.validated(lines, strict=strict)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, height, width, pixels): pages as grey bytes, by the JVM's decoder."""
    import numpy as np
    import pandas as pd

    from ..operators import image

    raw = spark.read.format("image").load(path).select(F.regexp_extract("image.origin", r"([^/]*)\.[^./]*$", 1).alias("page_id"), "image.height", "image.width", "image.nChannels", "image.data").filter("height > 0")

    def run(frames):
        for pdf in frames:
            made = [image.grey(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)) for r in pdf.itertuples()]
            yield pd.DataFrame({"page_id": pdf.page_id, "height": pdf.height, "width": pdf.width, "pixels": [np.ascontiguousarray(x).tobytes() for x in made]})

    return raw.mapInPandas(run, image.SCHEMA)


def corpus_rows(spark: SparkSession, path: str, n: int | None = None, *order: str) -> DataFrame:
    """A parquet corpus, its first n rows in a stated order."""
    rows = spark.read.parquet(path)
    return rows if n is None else rows.orderBy(*(order or rows.columns[:1])).limit(n)


def with_line_numbers(rows: DataFrame, by: str, *order: str) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
