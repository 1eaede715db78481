"""Images, readers, writers, the page pipeline, streams, and queries against their SQL."""

import json
from pathlib import Path
from xml.etree import ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium import stages
from scriptorium.operators import image
from scriptorium.plans import file_queries, pipeline, queries, rule_queries  # noqa: F401
from scriptorium.sources import readers, writers
from scriptorium.streaming import review

DATA = "/root/testdata/sf0.001"


def page(h=400, w=600):
    x = np.full((h, w), 240, np.uint8)
    for y in range(50, h - 40, 60):
        x[y : y + 30, 80:520] = 20
    return x


def frame(spark, **pages):
    return spark.createDataFrame([(k, *v.shape, bytearray(v.tobytes())) for k, v in pages.items()], image.SCHEMA)


def test_binarisation():
    x = page()
    t = image.otsu_threshold(x)
    assert 20 <= t < 240 and set(np.unique(image.otsu(x))) == {0, 255}
    small = np.random.default_rng(0).integers(0, 256, (30, 40)).astype(np.uint8)
    got, p = image.sauvola(small, 5), np.pad(small / 255.0, 2, mode="reflect")
    for y, c in ((0, 0), (10, 20), (29, 39)):
        w = p[y : y + 5, c : c + 5]
        assert (got[y, c] == 255) == (small[y, c] / 255.0 > w.mean() * (1 + 0.2 * (w.std() / 0.5 - 1)))


def test_geometry_of_pages():
    x = page()
    assert image.crop_white(x, white=200).shape == (30 * 6 + 30 * 5 + 20 - 0, 460) or image.crop_white(x, white=200).shape[1] == 460
    assert (image.crop_white(np.full((5, 5), 255, np.uint8)) == 255).all()
    assert image.resize(x, 100).shape == (100, 150) and image.target_size(10, 2000) == (384, 3840)
    assert image.deskew(x, 0.05).shape == x.shape and image.deskew(x, 5).shape[0] > x.shape[0]
    left, right = image.split_double(np.zeros((10, 100), np.uint8))
    assert left.shape == (10, 70) and right.shape == (10, 70)
    with pytest.raises(ValueError, match="double"):
        image.split_double(np.zeros((10, 12), np.uint8))
    assert image.median_skew(np.array([1.0, 2.0, 45.0, 4.0])) == 2.0 and image.median_skew(np.array([])) == 0.0
    flat = np.full((64, 64), 100, np.uint8)
    assert len(np.unique(image.clahe(flat))) == 1
    assert image.grey(np.dstack([flat, flat, flat])).tolist() == flat.tolist()


@pytest.mark.parametrize("angle", [-4.0, 0.0, 2.5])
def test_skew_is_found_and_undone(angle):
    turned = image.deskew(page(500, 900), -angle) if angle else page(500, 900)
    found = image.detect_skew(turned)
    assert abs(found - angle) <= 0.5 or abs(found + angle) <= 0.5
    assert abs(image.detect_skew(image.deskew(turned, found))) <= 0.5
    assert image.detect_skew(np.full((300, 300), 255, np.uint8)) == 0.0


def test_commands(spark, tmp_path):
    from scriptorium import __main__ as cli

    (tmp_path / "predictions.txt").write_text("a.png\tAnno domini MCC\nb.png\tin villa de Parisius\n", encoding="utf-8")
    (tmp_path / "test.txt").write_text("a.png\tAnno domini MCCX\nb.png\tin villa de Parisius\n", encoding="utf-8")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1.png").write_bytes(image.png(page()))
    cli.main(["analyse", "-i", str(tmp_path / "predictions.txt"), "-o", str(tmp_path / "a")])
    assert json.loads(spark.read.json(str(tmp_path / "a" / "corpus_report")).toJSON().first())["corpus_stats"]["total_documents"] == 2
    cli.main(["evaluate", "-p", str(tmp_path / "predictions.txt"), "-l", str(tmp_path / "test.txt"), "-o", str(tmp_path / "e")])
    assert spark.read.json(str(tmp_path / "e" / "report")).first().num_samples == 2
    spark.createDataFrame([(i, f"line {i}") for i in range(20)], "id bigint, text string").write.parquet(str(tmp_path / "corpus"))
    cli.main(["split", "-i", str(tmp_path / "corpus"), "-o", str(tmp_path / "s")])
    assert spark.read.text(str(tmp_path / "s")).count() == 20
    cli.main(["page", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "p"), "--skip-preprocessing", "--skip-nlp"])
    assert readers.contracts(spark, str(tmp_path / "p" / "contracts")).count() > 0
    with pytest.raises(SystemExit):
        cli.main(["analyse"])


def test_noise_goes():
    x = np.zeros((60, 60), np.uint8)
    x[5:30, 5:30], x[40:45, 40:45] = 255, 255
    out = image.remove_noise(x)
    assert out[10, 10] == 255 and out[42, 42] == 0


def test_image_frames(spark):
    s = image.statistics(frame(spark, a=page())).first()
    assert s["mean"] == pytest.approx(page().mean()) and s["std"] == pytest.approx(page().std()) and (s["min"], s["max"]) == (20, 240)
    two = image.mapped(frame(spark, d=np.zeros((10, 100), np.uint8)), image.split_double).collect()
    assert [(r.height, r.width) for r in two] == [(10, 70), (10, 70)]


def test_png_files_are_read_again(spark, tmp_path):
    x = page(30, 40)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1.png").write_bytes(image.png(x))
    got = readers.images(spark, str(tmp_path / "in")).first()
    assert got.page_id == "p1" and bytes(got.pixels) == x.tobytes()
    writers.write_images(frame(spark, p1=x), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().name == "p1.png"


def test_functions_in_sql(spark):
    from scriptorium.functions.register import register

    register(spark)
    assert spark.sql("select normalise_text('Nostre  carta') as x").first().x == "nostre charta"
    frame(spark, d=np.zeros((10, 100), np.uint8), s=np.zeros((10, 10), np.uint8)).createOrReplaceTempView("raster")
    got = spark.sql("select page_id, t.side, t.width from raster, lateral split_double_page(height, width, pixels) t").collect()
    assert {tuple(r) for r in got} == {("d", "left", 70), ("d", "right", 70), ("s", "whole", 10)}


def test_runs_as_json(spark):
    runs = spark.createDataFrame([(0, 8, 0.2), (1, 16, 0.1)], "run_idx int, r int, cer double")
    assert json.loads(writers.best_config(runs).first().json)["r"] == 16
    history = spark.createDataFrame([("a", 2, 0.1), ("a", 1, 0.3)], "run string, epoch int, cer double")
    assert [x["epoch"] for x in json.loads(writers.training_history(history).first().json)] == [1, 2]
    assert [r.is_best for r in writers.training_curves(history).orderBy("epoch").collect()] == [False, True]


def test_label_files(spark, tmp_path):
    p = tmp_path / "dev.txt"
    p.write_text("a.png\tone\ttwo\n\nno tab\n  b.png\té \nc.png\t[TODO_TRANSCRIPTION]\n", encoding="utf-8")
    assert [(r.img_name, r.text, r.img_path) for r in readers.labels(spark, str(p), "img/").orderBy("line_no").collect()] == [("a.png", "one\ttwo", "img/a.png"), ("b.png", "é", "img/b.png"), ("c.png", "[TODO_TRANSCRIPTION]", "img/c.png")]
    assert readers.training_labels(spark, str(p)).count() == 2 and readers.labels(spark, str(tmp_path / "none.txt")).count() == 0
    assert readers.split_path("d", "odd") == "d/dev.txt"
    assert [r.img_name for r in readers.by_shelfmark(spark, "B.P", str(tmp_path)).collect()] == ["b.png"]
    assert readers.by_shelfmark(spark, "zzz", str(tmp_path)) is None


def test_prediction_files(spark, tmp_path):
    sub = tmp_path / "x" / "y"
    sub.mkdir(parents=True)
    (sub / "predictions.txt").write_text("a.png\tone\n\nplain\na.jpg\tlast\n", encoding="utf-8")
    got = {r.id: (r.text, r.ord) for r in readers.predictions(spark, str(sub / "predictions.txt")).collect()}
    assert got == {"a": ("last", 0), "doc_0002": ("plain", 2)}
    assert {r.subdir for r in readers.discover(spark, str(tmp_path)).collect()} == {"x_y"}
    (tmp_path / "l.json").write_text(json.dumps([{"img_name": "i", "document_id": "d", "pred": "p", "text": "t"}, {"text": "u"}]))
    assert {r.id: r.text for r in readers.predictions(spark, str(tmp_path / "l.json")).collect()} == {"i": "p", "doc_1": "u"}
    assert {r.id: r.text for r in readers.transcriptions(spark, str(tmp_path / "l.json")).collect()} == {"d": "t", "doc_1": "u"}
    (tmp_path / "g.json").write_text(json.dumps({"lines": [{"line_id": "a", "transcription": "x"}, {"text": "y"}]}))
    assert {r.line_id: r.text for r in readers.ground_truth(spark, str(tmp_path / "g.json")).collect()} == {"a": "x", "line_0001": "y"}
    (tmp_path / "m.json").write_text(json.dumps({"k": "v"}))
    assert [(r.line_id, r.text) for r in readers.ground_truth(spark, str(tmp_path / "m.json")).collect()] == [("k", "v")]
    assert readers.ground_truth(spark, str(tmp_path / "l.json")).count() == 0
    assert readers.ground_truth(spark, None) is None and readers.ground_truth(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("method", ["kraken", "yolo"])
def test_page_pipeline(spark, tmp_path, method):
    pages = frame(spark, p1=page(), p2=page(300, 600))
    truth = spark.createDataFrame([("p1", f"p1_line_{i:04d}", t, i) for i, t in enumerate(["In nomine Domini amen", "Anno domini", "x"])], "document_id string, line_id string, text string, ord int")
    out = pipeline.run_pipeline(pages, pipeline.PipelineConfig(seg_method=method, skip_preprocessing=True), truth)
    lines = out["lines"].filter("document_id = 'p1'").orderBy("reading_order").collect()
    assert [r.reading_order for r in lines] == list(range(len(lines))) and lines[0].cer == 0.0 and lines[0].text == "In nomine Domini amen"
    summary = {r.document_id: r for r in out["pages"].collect()}
    assert summary["p1"].n_main == len(lines) and summary["p1"].num_aligned == 3 and summary["p1"].line_count_alert
    assert sum(summary["p1"].cer_distribution.values()) == 3
    text = [r.value for r in out["comparison_text"].filter("document_id = 'p1'").orderBy("section", "ord").collect()]
    assert "Document : p1" in text and "GT   : Anno domini" in text
    assert {r.document_id for r in out["final"].collect()} == {"p1", "p2"} and out["comparison"].count() == 2
    assert out["report"].filter("document_id = 'p1'").first().nlp_results.language in ("latin", "mixed")
    writers.write_contracts(out["entries"], str(tmp_path / "c"))
    again = readers.contracts(spark, str(tmp_path / "c")).filter("document_id = 'p1'")
    assert again.count() == len(lines)
    with pytest.raises(ValueError, match="unknown"):
        pipeline.run_pipeline(pages, pipeline.PipelineConfig(seg_method="x"))


def test_pipeline_with_a_transcriber_and_no_truth(spark):
    def load():
        return lambda images: ["ipsa verba" for _ in images]

    out = pipeline.run_pipeline(frame(spark, p=page()), pipeline.PipelineConfig(transcriber=load, skip_preprocessing=True, skip_nlp=True))
    rows = out["lines"].collect()
    assert rows and all(r.text == "ipsa verba" and r.confidence == 0.9 and r.cer == 0.0 for r in rows) and "final" not in out


def test_taggers_and_parsers_join_in(spark):
    from scriptorium.operators import nlp

    tag = stages.tagger(lambda: lambda s: [("Paris", "GPE", 0, 5)] if s else [], "spacy", labels=stages.SPACY_LABELS, confidence=stages.spacy_confidence)
    parse = stages.parser(lambda: lambda s: [("Petrus", "terram", s), ("x", "y", s)])
    row = nlp.analyse(spark.createDataFrame([("d", "Paris est")], "document_id string, transcription string"), taggers=[tag], parser=parse, rules=False).first()
    assert [(e.text, e.label, e.source, e.confidence) for e in row.entities] == [("Paris", "LOC", "spacy", 0.75)]
    assert [(r.subject, r.predicate, r.object) for r in row.relations] == [("Petrus", "donne_à", "terram")]


def test_evaluation(spark):
    truth = spark.createDataFrame([("a", "abcd"), ("b", "xy")], "img_name string, text string")
    pred = spark.createDataFrame([("a", "abce"), ("b", "")], "img_name string, pred string")
    out = pipeline.evaluate(pred, truth, model="m")
    r = out["report"].first()
    assert (r.cer, r.num_samples, r.model) == (3 / 6, 2, "m") and out["histogram"].count() == 20 and out["curve"].count() == 2


def test_page_xml(spark):
    region = ("r0", "text", [[0, 0], [9, 0], [9, 9]], [("l0", 0, [[1, 1], [2, 1], [2, 2]], [[1, 2], [2, 2]])])
    schema = "page_id string, image_path string, img_w int, img_h int, regions array<struct<region_id:string,region_type:string,polygon:array<array<int>>,lines:array<struct<line_id:string,reading_order:int,polygon:array<array<int>>,baseline:array<array<int>>>>>>, marginalia array<struct<line_id:string,reading_order:int,polygon:array<array<int>>,baseline:array<array<int>>>>"
    pages = spark.createDataFrame([("p", "a/b.png", 10, 20, [region], [("m0", -1, [[0, 0], [1, 0], [1, 1]], [])])], schema)
    root = ET.fromstring(writers.page_xml(pages).first().xml.encode())
    ns = {"p": writers.PAGE}
    assert root.find("p:Page", ns).get("imageFilename") == "b.png"
    assert [t.get("id") for t in root.iterfind(".//p:TextLine", ns)] == ["l0", "m0"]
    assert root.find(".//p:Baseline", ns).get("points") == "1,2 2,2"


def test_page_xml_is_made_and_read_without_python_or_xpath(spark, tmp_path):
    from scriptorium.plans import file_queries

    spark.createDataFrame([(1, i + 1, 1, i * 20, "A<&>\""[i % 2 :], 30.0) for i in range(5)], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = file_queries.sink_page_xml(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1 and "xpath" not in plan
    line = "array<struct<line_id:string,reading_order:int,polygon:array<array<double>>,baseline:array<array<double>>>>"
    pages = spark.createDataFrame([('p&"', "x/<a>.png", 1, 2, [], [('m\n<"', 3, [[1.9, -1.9]], None)]), ("q", "q", 1, 2, None, None)], f"page_id string, image_path string, img_w int, img_h int, regions array<struct<region_id:string,region_type:string,polygon:array<array<double>>,lines:{line}>>, marginalia {line}")
    made = writers.page_xml(pages, creator="a<b")
    assert "InPandas" not in made._jdf.queryExecution().executedPlan().toString()
    p, q = (ET.fromstring(r.xml.encode()) for r in made.orderBy("page_id").collect())
    ns = {"p": writers.PAGE}
    assert p.find(".//p:TextLine", ns).get("id") == 'm\n<"' and p.find(".//p:Coords", ns).get("points") == "1,-1" and p.find(".//p:TextRegion", ns).get("id") == 'p&"_marginalia'
    assert p.find("p:Page", ns).get("imageFilename") == "<a>.png" and p.find(".//p:Creator", ns).text == "a<b" and len(q.find("p:Page", ns)) == 0


def test_streams_equal_batches(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([(f"d{i}", f"Anno domini MCC in Parisius {i}") for i in range(6)], "document_id string, transcription string")
    rows.repartition(3).write.json(str(source))
    stream = review.analyses(review.documents(spark, str(source))).select("document_id", "language", F.size("entities").alias("n"))
    q = stream.writeStream.format("memory").queryName("analysed").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    from scriptorium.operators import nlp

    batch = nlp.analyse(rows).select("document_id", "language", F.size("entities").alias("n"))
    assert sorted(map(tuple, spark.table("analysed").collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("options", [{}, {"slide": "15 minutes"}, {"gap": "20 minutes", "by": ("user_id",)}])
def test_review_windows_equal_batches(spark, tmp_path, options):
    if not Path(DATA).is_dir():
        pytest.skip("no test tables here")
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("needs_review", F.col("value") < 0.8)
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = review.review_rate(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), **options)
    name = f"w{len(str(options))}"
    q = stream.writeStream.format("memory").queryName(name).outputMode("append" if options.get("gap") else "complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = set(map(tuple, spark.table(name).collect()))
    want = set(map(tuple, review.review_rate(events, **options).collect()))
    assert got <= want and (options.get("gap") or got == want)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    ours = queries.QUERIES[name](spark, DATA)
    cols = sorted(ours.columns)
    rel = con.sql(queries.SQL[name])
    at = [list(rel.columns).index(c) for c in cols]
    assert len(at) == len(rel.columns)
    plain = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(tuple(r) for r in ours.select(*cols).collect()) == plain(tuple(r[i] for i in at) for r in rel.fetchall())


def test_queries_without_sql_run(spark):
    if not Path(DATA).is_dir():
        pytest.skip("no test tables here")
    for name in sorted(set(queries.QUERIES) - set(queries.SQL)):
        assert queries.QUERIES[name](spark, DATA).count() > 0, name
