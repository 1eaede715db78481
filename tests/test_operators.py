"""Layout, alignment, contract, metrics, corpus and NLP operators."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import align, contract, corpus, layout, metrics, nlp

BOX = "page_id string, det_ord int, x0 int, y0 int, x1 int, y1 int, img_w int, img_h int, tag string, conf double"


def boxes(spark, rows, w=1000):
    return spark.createDataFrame([("p", i, *r[:4], w, 2000, r[4] if len(r) > 4 else "default", 0.9) for i, r in enumerate(rows)], BOX)


def test_routing_borders(spark):
    rows = [(300, 0, 379, 50), (300, 0, 380, 14), (300, 0, 380, 15), (300, 0, 700, 120), (300, 0, 700, 121), (300, 0, 481, 121), (300, 0, 482, 121), (119, 0, 468, 50), (119, 0, 469, 50), (120, 0, 469, 50), (540, 0, 880, 50), (540, 0, 881, 50), (300, 0, 600, 50, "Margin"), (300, 0, 600, 50, "odd")]
    got = [(r.route, r.reason, r.region_type) for r in layout.route(boxes(spark, rows)).orderBy("det_ord").collect()]
    m, t = ("main", None, "main_text"), ("discarded", "too_small", "main_text")
    assert got == [t, t, m, m, ("main", None, "heading"), ("discarded", "drop_capital", "heading"), ("main", None, "heading"), ("marginalia", None, "marginalia"), m, m, m, ("marginalia", None, "marginalia"), ("marginalia", None, "marginalia"), m]
    other = [(r.route, r.reason) for r in layout.route(boxes(spark, rows[:5]), "boxes").orderBy("det_ord").collect()]
    assert other[4] == ("discarded", "too_tall")
    with pytest.raises(ValueError, match="unknown"):
        layout.route(boxes(spark, rows), "x")


def test_ids_are_dense_by_route_and_keep_gaps_for_detectors(spark):
    rows = [(300, 0, 700, 50), (300, 0, 310, 50), (10, 0, 200, 50), (300, 60, 700, 90)]
    dense = [r.line_id for r in layout.number(layout.route(boxes(spark, rows))).orderBy("det_ord").collect()]
    assert dense == ["p_line_0000", None, "p_marg_0000", "p_line_0001"]
    gaps = [r.line_id for r in layout.number(layout.route(boxes(spark, rows), "boxes"), "boxes").orderBy("det_ord").collect()]
    assert gaps == ["p_line_0000", None, "p_marg_0000", "p_line_0003"]


def brute_order(rows):
    near = max(statistics.median(r[3] - r[1] for r in rows) * 0.6, 12.0)
    at = sorted(range(len(rows)), key=lambda i: ((rows[i][1] + rows[i][3]) / 2, rows[i][0], i))
    groups, mean = [], None
    for i in at:
        y = (rows[i][1] + rows[i][3]) / 2
        if mean is not None and abs(y - mean) <= near:
            groups[-1].append(i)
            mean = (mean * (len(groups[-1]) - 1) + y) / len(groups[-1])
        else:
            groups.append([i])
            mean = y
    flat = [i for g in groups for i in sorted(g, key=lambda i: (rows[i][0],))]
    return {i: k for k, i in enumerate(flat)}


def test_reading_order(spark):
    r = random.Random(2)
    rows = [(r.randrange(0, 400, 50), y := r.randrange(0, 300, 6), 900, y + r.choice([20, 30, 40])) for _ in range(30)]
    got = {x.det_ord: x.reading_order for x in layout.reading_order(boxes(spark, rows)).collect()}
    assert got == brute_order(rows)
    up = layout.reading_order(boxes(spark, rows), vertical=True).orderBy("reading_order").collect()
    assert [(x.x0, x.y0) for x in up] == sorted((a, b) for a, b, *_ in rows)


def test_geometry(spark):
    row = spark.range(1).select(
        layout.bbox(F.expr("array(array(3, 9), array(1, 4), array(7, 5))")).alias("b"),
        layout.baseline_y(F.expr("array(array(0, 4), array(1, 10), array(2, 5), array(3, 7))"), F.lit(0), F.lit(1)).alias("y"),
        layout.baseline_y(F.array().cast("array<array<int>>"), F.lit(3), F.lit(6)).alias("mid"),
        layout.polygon(F.expr("array(array(1.9, 2.9))"), F.lit(None).cast("array<array<double>>"), F.expr("array(1.9, 2.2, 3.7, 4.0)"), F.lit(9), F.lit(8)).alias("p"),
        layout.tag_of(F.lit('{"type": [{"type": "heading"}]}')).alias("t1"), layout.tag_of(F.lit('{"type": ["margin"]}')).alias("t2"), layout.tag_of(F.lit('{"type": "text"}')).alias("t3"), layout.tag_of(F.lit(None).cast("string")).alias("t4"), layout.tag_of(F.lit("plain")).alias("t5"), layout.tag_of(F.lit('{"type": []}')).alias("t6"),
        layout.is_double_page(F.lit(12), F.lit(10)).alias("d"), layout.is_double_page(F.lit(13), F.lit(10)).alias("e"), layout.is_double_page(F.lit(13), F.lit(0)).alias("z"),
    ).first()
    assert tuple(row.b) == (1, 4, 7, 9) and row.y == 6.0 and row.mid == 4.5
    assert row.p == [[1, 2], [3, 2], [3, 4], [1, 4]]
    assert (row.t1, row.t2, row.t3, row.t4, row.t5, row.t6) == ("heading", "margin", "text", "default", "plain", "default")
    assert (row.d, row.e, row.z) == (False, True, False)


def test_regions(spark):
    regions = spark.createDataFrame([("p", 0, 0), ("p", 0, 1), ("p", 1, 0)], "page_id string, type_ord int, ord int")
    assert [r.region_id for r in layout.region_ids(regions, shared=True).orderBy("type_ord", "ord").collect()] == ["p_region_000", "p_region_000", "p_region_001"]
    assert [r.region_id for r in layout.region_ids(regions).orderBy("type_ord", "ord").collect()] == ["p_region_000", "p_region_001", "p_region_002"]
    pages = spark.createDataFrame([("p", 10, 20), ("q", 10, 20), ("r", 1, 1)], "page_id string, img_w int, img_h int")
    made = layout.synthetic_regions(pages, regions, spark.createDataFrame([("p",), ("q",)], "page_id string")).collect()
    assert [(r.page_id, r.polygon[2]) for r in made] == [("q", [10, 20])]


def truth_lines(spark, lines, truth):
    a = spark.createDataFrame([("d", line, o) for line, o in lines], "document_id string, line_id string, reading_order int")
    b = spark.createDataFrame([("d", k, t, i) for i, (k, t) in enumerate(truth)], "document_id string, line_id string, text string, ord int")
    return {r.line_id: r.ground_truth for r in align.align(a, b).collect()}


def test_alignment_by_id_then_by_place(spark):
    lines = [("d_line_0", 0), ("line_1", 1), ("line_2", 2)]
    assert truth_lines(spark, lines, [("line_0", "A"), ("d_line_1", "B"), ("line_2", "C"), ("d_line_2", "D")]) == {"d_line_0": "A", "line_1": "B", "line_2": "C"}
    assert truth_lines(spark, lines, [("x", "A"), ("line_1", "B"), ("y", "C")]) == {"d_line_0": "A", "line_1": "B", "line_2": "C"}
    assert truth_lines(spark, lines, [("line_2", "A"), ("line_1", "B")]) == {"d_line_0": None, "line_1": "B", "line_2": "A"}


POLY = [[0, 0], [9, 0], [9, 9]]


def entries(spark, rows, **options):
    frame = spark.createDataFrame([("d", f"l{i}", t, c, p, i, None) for i, (t, c, p) in enumerate(rows)], "document_id string, line_id string, text string, confidence double, polygon array<array<int>>, reading_order int, region_type string")
    return contract.contract_lines(frame, **options)


def test_contract_lines(spark):
    got = entries(spark, [("In nomine Domini amen", 0.92, POLY), (" low ", 0.65, POLY), ("x", 1.7, POLY)]).orderBy("line_id").collect()
    assert [r.needs_review for r in got] == [False, True, True]
    assert [(r.transcription, r.confidence, r.region_type) for r in got][1:] == [("low", 0.65, "main_text"), ("x", 1.0, "main_text")]
    with pytest.raises(Exception, match="polygon"):
        entries(spark, [("a b", 0.9, POLY[:2])]).collect()
    assert entries(spark, [("a b", 0.9, POLY[:2])], strict=False).first().rejected


def test_violations_and_statistics(spark):
    good = entries(spark, [("In nomine Domini amen", 0.92, POLY), ("low", 0.65, POLY)])
    assert all(not r.violations for r in contract.validated(good, strict=False).collect())
    bad = good.withColumns({"confidence": F.lit(1.2), "reading_order": F.lit(-1), "region_type": F.lit("x")})
    assert bad.select(contract.violations().alias("v")).first().v == ["confidence outside 0..1", "reading_order negative", "region_type unknown"]
    with pytest.raises(Exception, match="contract"):
        contract.validated(bad).collect()
    s = contract.stats(good).first()
    assert (s.total_lines, s.needs_review_count, s.avg_confidence, s.confidence_distribution["0.5-0.7"], s.region_distribution) == (2, 1, 0.785, 1, {"main_text": 2})
    nested = contract.documents(good)
    assert [x.line_id for x in contract.lines_of(nested).orderBy("line_ord").collect()] == ["l0", "l1"]


def test_merged_pages_interleave_or_stay_together(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0), ("b", 0, 1, 1), ("c", 1, 0, 0), ("e", 1, 1, 1)], "line_id string, contract_ord int, line_ord int, reading_order int")
    assert [r.line_id for r in contract.merge(rows, "m").orderBy("reading_order").collect()] == ["a", "c", "b", "e"]
    assert [r.line_id for r in contract.merge(rows, "m", strict_pages=True).orderBy("reading_order").collect()] == ["a", "b", "c", "e"]


def test_rates_and_runs(spark):
    rows = spark.createDataFrame([("abcd", "abcd"), ("ab", "xx"), ("", "zz")], "ground_truth string, text string")
    scored = metrics.with_metrics(rows)
    m, a = metrics.micro(scored).first(), metrics.macro(scored).first()
    assert (m.char_edits, m.char_len) == (3, 7) and a.cer_global == 0.5 and a.num_aligned == 2
    runs = spark.createDataFrame([(0, 0.2, 0.5), (1, 0.1, 0.6), (2, 0.1, 0.4), (3, None, None)], "run_idx int, cer double, wer double")
    assert metrics.best_run(runs).first().run_idx == 1 and metrics.best_run(runs, "wer").first().run_idx == 2
    with pytest.raises(ValueError, match="metric"):
        metrics.best_run(runs, "bleu")
    h = metrics.histogram(spark.createDataFrame([(0.0,), (0.05,), (1.0,)], "x double"), "x").orderBy("bin").collect()
    assert len(h) == 20 and (h[0].n, h[1].n, h[19].n) == (1, 1, 1)
    assert spark.range(1).select(metrics.swapped_cer(F.lit("abcd"), F.lit("ab")), metrics.swapped_cer(F.lit("a"), F.lit(" "))).first()[:] == (1.0, 1.0)


def test_splits(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("le chevalier donna la terre").alias("text"))
    for total, n in ((400, 400), (None, 1000)):
        out = corpus.split(rows, key="k", total=total).collect()
        sizes = {s: sum(r.split == s for r in out) for s in ("train", "dev", "test")}
        assert sizes == {"train": int(n * 0.9), "dev": int(n * 0.05), "test": n - int(n * 0.9) - int(n * 0.05)}
        assert len({r.k for r in out}) == len({r.img_name for r in out}) == n and "dev_0000.png" in {r.img_name for r in out}
    with pytest.raises(ValueError, match="ratios"):
        corpus.split(rows, key="k", ratios=(0.5, 0.4, 0.2))
    g = [(r.lr, r.lora_r, r.lora_alpha) for r in corpus.grid(spark).orderBy("run_idx").collect()]
    assert g == [(5e-5, 8, 16), (5e-5, 16, 32), (1e-4, 8, 16), (1e-4, 16, 32)]


CHARTER = "Anno domini millesimo ducentesimo. Ego frater Johannes de Castro, donavit Petrus terram ad Ecclesiam Romanam, 20 solidi. Actum apud Parisius die dominica, testis Robertus. Sanctus Martinus in 1234."


def test_rules_and_offsets(spark):
    row = nlp.analyse(spark.createDataFrame([("d", CHARTER), ("e", None), ("f", "")], "document_id string, transcription string")).orderBy("document_id").collect()
    d = row[0]
    assert all(d.normalized_text[e.start : e.end] == e.text for e in d.entities)
    assert {"DATE", "PER", "LOC", "MONEY"} <= {e.label for e in d.entities}
    assert {"lieu_de", "témoin_de", "montant"} <= {r.predicate for r in d.relations}
    assert [e.start for e in d.entities] == sorted(e.start for e in d.entities)
    assert [(r.normalized_text, len(r.entities), r.confidence, r.language) for r in row[1:]] == [("", 0, 0.0, "mixed")] * 2
    report = {(r.kind, r.key): r.n for r in nlp.report(nlp.analyse(spark.createDataFrame([("d", CHARTER)], "document_id string, transcription string"))).collect()}
    assert report["total", "documents"] == 1 and report["total", "entities"] == len(d.entities)


ENTITY = "document_id string, ord int, text string, label string, start int, end int, source string, confidence double"


def test_dedup_keeps_the_best_and_the_order_of_first_sight(spark):
    rows = [("B", "PER", 5, 0.5), ("a", "PER", 5, 0.6), ("b ", "PER", 5, 0.9), ("A", "PER", 5, 0.6), ("c", "LOC", 1, 0.1)]
    frame = spark.createDataFrame([("d", i, t, k, s, s + 1, f"s{i}", c) for i, (t, k, s, c) in enumerate(rows)], ENTITY)
    want = ["s4", "s2", "s1"]
    assert [r.source for r in nlp.dedup_entity_rows(frame).orderBy("rank").collect()] == want
    nested = frame.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct("text", "label", "start", "end", "source", "confidence").alias("e")))), lambda x: x["e"]).alias("e"))
    assert [x.source for x in nested.select(nlp.dedup_entities(F.col("e")).alias("e")).first().e] == want


def test_proximity_border(spark):
    rows = [("P", "PER", 0), ("D", "DATE", 79), ("E", "DATE", 80), ("P", "LOC", 3), ("L", "LOC", 5)]
    frame = spark.createDataFrame([("d", i, t, k, s, s + 1, "r", 0.5) for i, (t, k, s) in enumerate(rows)], ENTITY)
    assert {(r.subject, r.object) for r in nlp.proximity_rows(frame).collect()} == {("P", "D"), ("P", "L")}
    nested = frame.groupBy("document_id").agg(F.collect_list(F.struct("text", "label", "start", "end", "source", "confidence")).alias("e"))
    got = nested.select(nlp.proximity(F.lit("x" * 90), F.col("e")).alias("r")).first().r
    assert {(r.subject, r.predicate, r.object) for r in got} == {("P", "date_associée", "D"), ("P", "associé_à_lieu", "L")}


def test_themes(spark):
    texts = ["carta sigillum testis notarius", "In nomine domini amen", "nothing of the kind", "deus rex"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [[tuple(x) for x in r.th] for r in frame.select("i", nlp.themes(F.col("t")).alias("th")).orderBy("i").collect()]
    assert got[0] == [("juridique", 1.0)] and got[2] == []
    assert got[1][0] == ("religieux", 1.0) and got[1][1][0] == "juridique"
    assert [x[0] for x in got[3]] == ["religieux"] or got[3][0][0] == "religieux"
