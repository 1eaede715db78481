"""Registered queries of sources and sinks: files are written from the driver's tables and read again.

Turns of conversations are lines of pages, their conversation the page; white space in a
line is one blank, since a line has no breaks of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, layout, metrics, nlp
from ..sources import readers, scratch, writers
from .queries import _BOX, _ENTRY, _LANGUAGE, _METRICS, _ROUTE, _SPACE, _boxes, _entries, _scored, query, table

# a line's name says its split and its place; every line of text has letters
_SPLIT = "case when turn % 4 < 2 then 'train' when turn % 4 = 2 then 'dev' else 'test' end"
_LINES = f"(select *, case when turn % 3 = 0 and conv_id % 2 = 0 then '[TODO_TRANSCRIPTION]' else line end as label from (select conv_id, turn, {_SPLIT} as split, conv_id::varchar || '_' || turn::varchar as name, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')) as line from conversations where text is not null) where line <> '')"


def _lines(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    split = F.when(F.col("turn") % 4 < 2, "train").when(F.col("turn") % 4 == 2, "dev").otherwise("test")
    rows = c.select("conv_id", "turn", split.alias("split"), F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("name"), F.trim(F.regexp_replace("text", f"{text.WS}+", " ")).alias("line")).filter("line <> ''")
    return rows.withColumn("label", F.when((F.col("turn") % 3 == 0) & (F.col("conv_id") % 2 == 0), readers.TODO).otherwise(F.col("line")))


def _label_folder(spark, sf_dir) -> str:
    """A folder with a file of labels for each split."""
    path = scratch.folder(spark, "labels")
    for s in readers.SPLITS:
        rows = _lines(spark, sf_dir).filter(F.col("split") == s)
        writers.prediction_lines(rows.select(F.concat("name", F.lit(".png")).alias("img_name"), F.col("label").alias("pred"))).write.text(readers.split_path(path, s))
    return path


@query(f"select name || '.png' as img_name, label as text, 'img/' || name || '.png' as img_path from {_LINES} where split = 'dev'")
def source_labels(spark, sf_dir):
    path = readers.split_path(_label_folder(spark, sf_dir), "dev")
    return readers.labels(spark, path, "img").select("img_name", "text", "img_path")


@query(f"select name || '.png' as img_name, label as text from {_LINES} where split = 'train' and label <> '[TODO_TRANSCRIPTION]'")
def source_training_labels(spark, sf_dir):
    path = readers.split_path(_label_folder(spark, sf_dir), "train")
    return readers.training_labels(spark, path, "img").select("img_name", "text")


@query(f"select name || '.png' as img_name, label as text, case split when 'train' then 0 when 'dev' then 1 else 2 end::int as split_ord from {_LINES} where contains(name, '7_')")
def source_by_shelfmark(spark, sf_dir):
    found = readers.by_shelfmark(spark, "7_", _label_folder(spark, sf_dir))
    return found.select("img_name", "text", "split_ord")


@query("select split, split || '.txt' as file, n::bigint as n from (select case s when 0 then 'train' when 1 then 'dev' when 2 then 'test' else 'odd' end as split, n from (select turn % 4 as s, count(*) as n from conversations group by 1)) where split <> 'odd' union all select 'other', 'dev.txt', (select count(*) from conversations where turn % 4 = 3)::bigint")
def source_split_path(spark, sf_dir):
    """What file a split's labels are in; dev's for a name that is none."""
    t = table(spark, sf_dir, "conversations").groupBy((F.col("turn") % 4).alias("s")).agg(F.count("*").alias("n"))
    name = F.when(F.col("s") == 0, "train").when(F.col("s") == 1, "dev").when(F.col("s") == 2, "test").otherwise("other")
    files = F.create_map(*(F.lit(x) for s in ("train", "dev", "test", "other") for x in (s, readers.split_path("", s).lstrip("/"))))
    return t.select(name.alias("split"), files[name].alias("file"), "n")


@query(f"select name as id, line as text from {_LINES}")
def source_predictions(spark, sf_dir):
    path = scratch.folder(spark, "predictions")
    writers.write_predictions(_lines(spark, sf_dir).select(F.concat("name", F.lit(".png")).alias("img_name"), F.col("line").alias("pred")), path)
    return readers.predictions(spark, path).select("id", "text")


def _records(spark, sf_dir, name: str, row, whole=None) -> str:
    """A folder of JSON files, one for 64 conversations."""
    path = f"{scratch.folder(spark, name)}.json"
    listed = _lines(spark, sf_dir).groupBy(F.floor(F.col("conv_id") / 64).alias("part")).agg(F.transform(F.sort_array(F.collect_list(F.struct("conv_id", "turn", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    value = F.to_json(F.struct(F.col("rows").alias(whole)) if whole else F.col("rows"))
    listed.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query(f"select name as id, line as text from {_LINES}")
def source_prediction_records(spark, sf_dir):
    """A list of records: the image's name counts before the document's, the prediction before the text."""
    row = F.struct(F.col("name").alias("img_name"), F.concat(F.lit("d"), "name").alias("document_id"), F.col("line").alias("pred"), F.col("label").alias("text"))
    return readers.predictions(spark, _records(spark, sf_dir, "records", row)).select("id", "text")


@query(f"select 'd' || name as id, line as text from {_LINES}")
def source_transcriptions(spark, sf_dir):
    """The same the other way round, and a `pred` that does not count."""
    row = F.struct(F.col("name").alias("img_name"), F.concat(F.lit("d"), "name").alias("document_id"), F.lit("no").alias("pred"), F.col("line").alias("transcription"), F.col("label").alias("text"))
    return readers.transcriptions(spark, _records(spark, sf_dir, "transcriptions", row)).select("id", "text")


@query(f"select name as line_id, line as text from {_LINES}")
def source_ground_truth(spark, sf_dir):
    path = scratch.folder(spark, "truth")
    writers.write_predictions(_lines(spark, sf_dir).select("name", F.col("name").alias("img_name"), F.col("line").alias("pred")), path)
    return readers.ground_truth(spark, path).select("line_id", "text")


@query(f"select name as line_id, line as text from {_LINES}")
def source_ground_truth_records(spark, sf_dir):
    row = F.struct(F.col("name").alias("line_id"), F.col("line").alias("transcription"))
    return readers.ground_truth(spark, _records(spark, sf_dir, "truth", row, "lines")).select("line_id", "text")


@query(f"select 'split=' || split as subdir, name as id, label as text from {_LINES}")
def source_discover(spark, sf_dir):
    """All files below a folder, with the folder that each is in."""
    root = scratch.folder(spark, "found")
    writers.write_label_files(_lines(spark, sf_dir).select("split", F.concat("name", F.lit(".jpg")).alias("img_name"), F.col("label").alias("text")), root)
    return readers.discover(spark, root, "part-*").select("subdir", "id", "text")


@query(f"select split, name || '.png' as img_name, label as text from {_LINES}")
def sink_label_files(spark, sf_dir):
    path = scratch.folder(spark, "labels")
    writers.write_label_files(_lines(spark, sf_dir).select("split", F.concat("name", F.lit(".png")).alias("img_name"), F.col("label").alias("text")), path)
    parts = [readers.labels(spark, f"{path}/split={s}").select(F.lit(s).alias("split"), "img_name", "text") for s in readers.SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"select name || '.png' || chr(9) || line as value from {_LINES}")
def sink_predictions(spark, sf_dir):
    path = scratch.folder(spark, "predictions")
    writers.write_predictions(_lines(spark, sf_dir).select(F.concat("name", F.lit(".png")).alias("img_name"), F.col("line").alias("pred")), path)
    return spark.read.text(path)


@query("select doc_id, n_chars from documents order by doc_id limit 50")
def source_first_rows(spark, sf_dir):
    """The first rows of a corpus in a stated order: that is the feature."""
    return readers.corpus_rows(spark, f"{sf_dir}/documents.parquet", 50, "doc_id").select("doc_id", "n_chars")


@query(f"select document_id, (row_number() over (partition by document_id order by reading_order, line_id) - 1)::int as line_ord, line_id, transcription, confidence, needs_review, reading_order, region_type from {_ENTRY}")
def source_contracts(spark, sf_dir):
    """Contracts as they are written, one document a line of JSON, and read again; both ways check the rules."""
    path = scratch.folder(spark, "contracts")
    writers.write_contracts(_entries(spark, sf_dir), path)
    return readers.contracts(spark, path, multi_line=False).select("document_id", "line_ord", "line_id", "transcription", "confidence", "needs_review", "reading_order", "region_type")


@query(f"select document_id, 'origin_top_left' as system_coordinates, count(*)::int as n_lines, string_agg(line_id, ' ' order by reading_order, line_id) as line_ids from {_ENTRY} group by 1")
def sink_contracts(spark, sf_dir):
    path = scratch.folder(spark, "contracts")
    writers.write_contracts(_entries(spark, sf_dir), path)
    rows = spark.read.schema(readers.CONTRACT).json(path)
    return rows.select("document_id", "system_coordinates", F.size("lines").alias("n_lines"), F.array_join(F.transform("lines", lambda x: x["line_id"]), " ").alias("line_ids"))


@query(f"""select doc_id::varchar as document_id, case when latin * 2 > french * 3 then 'latin' when french * 2 > latin * 3 then 'old_french' else 'mixed' end as language, text as transcription, '1.0.0' as version, '2024-01-02T03:04:05.000000' as processed_at from ({_LANGUAGE}) join documents using (doc_id)""")
def sink_analyses(spark, sf_dir):
    path = scratch.folder(spark, "analyses")
    found = nlp.analyse(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")
    writers.write_analyses(found, path, at=F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    at = lambda p: F.get_json_object("value", p)
    return spark.read.text(path).select(at("$.document_id").alias("document_id"), at("$.language").alias("language"), at("$.transcription").alias("transcription"), at("$.metadata.pipeline_version").alias("version"), at("$.metadata.processed_at").alias("processed_at"))


@query(f"select round(sum(char_edits) / sum(char_len), 6) as cer, round(sum(word_edits) / sum(word_len), 6) as wer, round(1 - sum(char_edits) / sum(char_len), 6) as accuracy, count(*)::bigint as num_samples, 'm' as model, 'base' as model_type, '' as checkpoint, false as lora_loaded from {_METRICS}")
def sink_evaluation_report(spark, sf_dir):
    path = scratch.folder(spark, "report")
    writers.evaluation_report(_scored(spark, sf_dir), model="m", model_type="base").write.json(path)
    back = spark.read.schema("cer double, wer double, accuracy double, num_samples bigint, model string, model_type string, checkpoint string, lora_loaded boolean").json(path)
    return back.withColumns({c: F.round(c, 6) for c in ("cer", "wer", "accuracy")})


# pages of comparisons: of five turns three are main lines, one is marginalia, one is discarded
_COMPARED = f"""(select conv_id::varchar as document_id, conv_id || '_' || turn as line_id, turn as reading_order, case when turn % 5 < 3 then 'main' when turn % 5 = 3 then 'marginalia' else 'discarded' end as route,
case when turn % 2 = 0 then '' else t end as truth, p as pred, case when turn % 2 = 0 then 0.0::double else char_edits / char_len end as cer, case when turn % 2 = 0 then 0.0::double else word_edits / word_len end as wer, 0.5 + (turn % 10) / 20.0 as confidence, '(' || turn || ', 0, 9, 9)' as bbox from {_METRICS})"""
_COMPARED_PAGES = f"(select document_id, avg(cer) filter (route = 'main' and truth <> '') as cer_global, avg(wer) filter (route = 'main' and truth <> '') as wer_global, document_id::bigint % 3 > 0 as has_truth, count(*) filter (route = 'main') as n, count(*) filter (route = 'main' and truth <> '') as aligned, count(*) filter (route = 'marginalia') as marg, count(*) filter (route = 'discarded') as gone from {_COMPARED} group by 1)"


def _compared(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = _scored(spark, sf_dir)
    turn, even = F.col("turn"), F.col("turn") % 2 == 0
    route = F.when(turn % 5 < 3, "main").when(turn % 5 == 3, "marginalia").otherwise("discarded")
    lines = s.select(
        F.col("conv_id").cast("string").alias("document_id"), F.concat_ws("_", F.col("conv_id").cast("string"), turn.cast("string")).alias("line_id"), turn.cast("int").alias("reading_order"), route.alias("route"),
        F.when(even, "").otherwise(text.blank_guard(F.col("truth"))).alias("ground_truth"), text.blank_guard(F.col("pred")).alias("text"), F.when(even, 0.0).otherwise(F.col("cer")).alias("cer"), F.when(even, 0.0).otherwise(F.col("wer")).alias("wer"),
        (F.lit(0.5) + (turn % 10) / 20.0).alias("confidence"), F.format_string("(%d, 0, 9, 9)", turn.cast("int")).alias("bbox"), F.concat(F.lit("r"), (turn % 3).cast("string")).alias("reason"),
        (turn % 2 == 1).alias("needs_review"), F.lit("main_text").alias("region_type"), turn.cast("int").alias("height"), F.lit(9).alias("width"), turn.cast("int").alias("det_ord"),
    )
    rated = lines.filter("route = 'main' and ground_truth <> ''").groupBy("document_id").agg(F.avg("cer").alias("cer_global"), F.avg("wer").alias("wer_global"))
    pages = lines.select("document_id").distinct().join(rated, "document_id", "left").withColumn("has_truth", F.col("document_id").cast("bigint") % 3 > 0)
    return lines, pages


_PERCENT = "format('{{:.2f}}%', round({} * 100, 2))"


@query(f"""select document_id, 0 as section, s as value from {_COMPARED_PAGES}, unnest(['Document : ' || document_id] || case when has_truth then ['Lignes transcrites : ' || n, 'Lignes GT alignées : ' || aligned, 'Marginalia détectées : ' || marg, 'Lignes rejetées : ' || gone] else [] end) u(s)
union all select document_id, 1, s from {_COMPARED}, unnest(list_filter(['--- ' || line_id || ' (ro=' || reading_order || ') ---', case when truth <> '' then 'GT   : ' || truth end, 'PRED : ' || pred, case when truth = '' then format('CONF : {{:.2f}} (sans GT)', confidence) end], lambda x: x is not null)) u(s) where route = 'main'
union all select document_id, 2, s from {_COMPARED}, unnest(['--- ' || line_id || ' ---', 'BBOX : ' || bbox, format('CONF : {{:.2f}}', confidence)]) u(s) where route = 'marginalia'
union all select document_id, 3, 'Raison : r' || (reading_order % 3) || ' | BBOX : ' || bbox from {_COMPARED} where route = 'discarded'""")
def sink_comparison_text(spark, sf_dir):
    """The lines of a comparison but rules, blank ones, and those with rates, which sink_comparison has as numbers."""
    path = scratch.folder(spark, "comparison")
    writers.comparison_text(*_compared(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path).filter("value <> '' and not value rlike '^(=+$|COMPARAISON|CER |WER )'").select("document_id", "section", "value")


@query(f"""select c.document_id, has_truth, round(cer_global, 6) as cer_global, n::int as n_lines, marg::int as n_marginalia, gone::int as n_discarded, coalesce(string_agg(line_id, ' ' order by reading_order) filter (route = 'main'), '') as line_ids, round(coalesce(sum(cer) filter (route = 'main'), 0), 6) as cer_sum
from {_COMPARED} c join {_COMPARED_PAGES} using (document_id) group by all""")
def sink_comparison(spark, sf_dir):
    lines, pages = _compared(spark, sf_dir)
    full = pages.withColumns({"line_count_alert": F.lit(False), "avg_confidence": F.lit(0.5), "needs_review_rate": F.lit(0.0), "cer_distribution": F.create_map(F.lit("bon"), F.lit(1))})
    path = scratch.folder(spark, "comparison")
    made = writers.comparison_json(lines, full)
    made.write.json(path)
    back = spark.read.schema(made.schema).json(path)
    total = F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["cer"])
    return back.select("document_id", F.col("has_ground_truth").alias("has_truth"), F.round("metrics.cer_global", 6).alias("cer_global"), F.col("segmentation_info.num_lines_detected").alias("n_lines"), F.size("marginalia").alias("n_marginalia"), F.size("discarded").alias("n_discarded"), F.array_join(F.transform("lines", lambda x: x["line_id"]), " ").alias("line_ids"), F.round(total, 6).alias("cer_sum"))


@query(f"""select e.document_id, n_lines, full_text, '2.2.0' as pipeline_version, case when latin * 2 > french * 3 then 'latin' when french * 2 > latin * 3 then 'old_french' else 'mixed' end as language, true as nlp_available
from (select document_id, count(*)::int as n_lines from {_ENTRY} group by 1) e join (select conv_id::varchar as document_id, string_agg(text, ' ' order by turn) as full_text from conversations group by 1) t using (document_id)
join ({_LANGUAGE.replace("from documents", "from (select conv_id::varchar as doc_id, string_agg(text, ' ' order by turn) as text from conversations group by 1)")}) l on l.doc_id = e.document_id""")
def sink_final_documents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("reading_order"), "text")
    whole = writers.full_text(c)
    pages = whole.select("document_id", F.lit(0.1).alias("cer_global"))
    found = nlp.analyse(whole, text_col="full_text")
    made = writers.final_document(pages, _entries(spark, sf_dir), found, whole)
    path = scratch.folder(spark, "final")
    made.write.json(path)
    back = spark.read.schema(made.schema).json(path)
    return back.select("document_id", F.size("lines").alias("n_lines"), "full_text", "pipeline_version", F.col("nlp_results.language").alias("language"), "nlp_available")


@query(f"""select page_id, count(*) filter (route = 'main')::int as n_lines, count(*) filter (route = 'marginalia')::int as n_marginalia, count(*) filter (route = 'discarded')::int as n_discarded, 1500 as img_h, 1000 as img_w, 1 as n_regions,
coalesce(sum(x0) filter (route = 'main'), 0)::bigint as x0_sum from {_ROUTE} group by 1""")
def sink_segmentation(spark, sf_dir):
    routed = layout.route(_boxes(spark, sf_dir))
    lines = routed.withColumns({"reading_order": F.col("det_ord"), "line_id": F.concat_ws("_", "page_id", F.col("det_ord").cast("string")), "conf": F.lit(0.9)})
    pages = routed.select("page_id", "img_h", "img_w").distinct().withColumn("image_path", F.concat("page_id", F.lit(".png")))
    made = writers.segmentation_json(pages, lines, layout.synthetic_regions(pages, lines.limit(0), lines))
    path = scratch.folder(spark, "segmentation")
    made.write.json(path)
    back = spark.read.schema(made.schema).json(path)
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["bbox"][0])
    return back.select("page_id", F.size("lines").alias("n_lines"), F.size("marginalia").alias("n_marginalia"), F.size("discarded").alias("n_discarded"), F.col("image_shape")[0].alias("img_h"), F.col("image_shape")[1].alias("img_w"), F.size("regions").alias("n_regions"), total.alias("x0_sum"))


_TEXT_LINES = "array<struct<Coords:struct<_points:string>>>"
_PAGE_XML = f"Metadata struct<Creator:string>, Page struct<_imageFilename:string,_imageWidth:int,TextRegion:array<struct<_type:string,TextLine:{_TEXT_LINES}>>>"


@query(f"""select page_id, count(*) filter (route = 'main')::int as n_main, count(*) filter (route = 'marginalia')::int as n_marginalia, page_id || '.png' as file, 1000 as img_w, 'b' as creator,
coalesce(first(x0 || ',' || y0 || ' ' || x1 || ',' || y0 || ' ' || x1 || ',' || y1 || ' ' || x0 || ',' || y1 order by det_ord, x0, y0, x1, y1) filter (route = 'main'), '') as first_points from {_ROUTE} group by 1""")
def sink_page_xml(spark, sf_dir):
    routed = layout.route(_boxes(spark, sf_dir))
    shape = layout.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    line = F.struct(F.concat_ws("_", "page_id", F.col("det_ord").cast("string")).alias("line_id"), F.col("det_ord").alias("reading_order"), shape.alias("polygon"), F.array().cast("array<array<int>>").alias("baseline"))
    of = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("route") == r, F.struct("det_ord", "x0", "y0", "x1", "y1", line.alias("l"))))), lambda x: x["l"])
    nested = routed.groupBy("page_id", "img_w", "img_h").agg(of("main").alias("main"), of("marginalia").alias("marginalia"))
    region = F.struct(F.lit("r0").alias("region_id"), F.lit("text").alias("region_type"), layout.rectangle(F.lit(0), F.lit(0), F.lit(9), F.lit(9)).alias("polygon"), F.col("main").alias("lines"))
    pages = nested.select("page_id", F.concat(F.lit("a/"), "page_id", F.lit(".png")).alias("image_path"), "img_w", "img_h", F.array(region).alias("regions"), "marginalia")
    path = scratch.folder(spark, "xml")
    writers.page_xml(pages, creator="b").write.parquet(path)
    back = spark.read.parquet(path).select("page_id", F.from_xml("xml", _PAGE_XML).alias("x"))  # each file is parsed once
    lines = lambda kind: F.flatten(F.transform(F.filter("x.Page.TextRegion", lambda r: r["_type"] == kind), lambda r: F.coalesce(r["TextLine"], F.array().cast(_TEXT_LINES))))
    count = lambda kind: F.size(F.coalesce(lines(kind), F.array().cast(_TEXT_LINES)))
    return back.select(
        "page_id", count("text").alias("n_main"), count("marginalia").alias("n_marginalia"), F.col("x.Page._imageFilename").alias("file"), F.col("x.Page._imageWidth").alias("img_w"), F.col("x.Metadata.Creator").alias("creator"),
        F.coalesce(F.get(lines("text"), F.lit(0))["Coords"]["_points"], F.lit("")).alias("first_points"),
    )


@query("select l_suppkey::varchar || '.png' as name, count(*)::int as width, 1 as height from lineitem group by l_suppkey")
def sink_images(spark, sf_dir):
    """Pages as PNG; width and height are read from the files' own heads."""
    from .queries import _rasters

    path = scratch.folder(spark, "images")
    writers.write_images(_rasters(spark, sf_dir), path)
    size = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return spark.read.parquet(path).select("name", size(17).alias("width"), size(21).alias("height"))


# --- plot data, runs --------------------------------------------------------------------


@query(f"select (row_number() over (order by char_edits / char_len) - 1)::bigint as place, round(char_edits / char_len, 6) as value from {_METRICS}")
def plot_error_curve(spark, sf_dir):
    return writers.error_curve(_scored(spark, sf_dir)).select((F.col("place") - 1).cast("bigint").alias("place"), F.round("value", 6).alias("value"))


@query("""select o_custkey as run, o_orderkey as epoch, o_totalprice as cer, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) = 1 as is_best from orders""")
def plot_training_curves(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("cer"))
    return writers.training_curves(o).select("run", "epoch", "cer", "is_best")


@query(f"""select name as img_name, round(cer, 6) as cer, case when cer < 0.1 then 'green' when cer < 0.3 then 'orange' else 'red' end as colour from (select conv_id || '_' || turn as name, case when sp = '' or st = '' then 1.0 else swapped / length(sp) end as cer from {_METRICS}) order by md5('42:' || name), name limit 16""")
def plot_prediction_grid(spark, sf_dir):
    """Sixteen predictions by a hash of their names: a sample is the feature."""
    rows = _scored(spark, sf_dir).select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("img_name"), "truth", "pred")
    return writers.prediction_grid(rows, 16).select("img_name", F.round("cer", 6).alias("cer"), "colour")


@query("select s_suppkey::bigint as run_idx, s_acctbal as cer, s_nationkey::bigint as lora_r from supplier order by s_acctbal, s_suppkey limit 1")
def sink_best_config(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("run_idx"), F.col("s_acctbal").alias("cer"), F.col("s_nationkey").alias("lora_r"))
    path = scratch.folder(spark, "best")
    writers.best_config(s).select("json").write.text(path)
    return spark.read.schema("run_idx bigint, cer double, lora_r bigint").json(path)


@query("select o_custkey as run, count(*)::int as epochs, string_agg(o_orderkey::varchar, ' ' order by o_orderkey) as order_of, round(sum(o_totalprice), 2) as total from orders group by 1")
def sink_training_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("cer"))
    path = scratch.folder(spark, "history")
    writers.training_history(o).write.parquet(path)
    back = spark.read.parquet(path).select("run", F.from_json("json", "array<struct<epoch:bigint,cer:double>>").alias("h"))
    return back.select("run", F.size("h").alias("epochs"), F.array_join(F.transform("h", lambda x: x["epoch"].cast("string")), " ").alias("order_of"), F.round(F.aggregate("h", F.lit(0.0), lambda a, x: a + x["cer"]), 2).alias("total"))
