"""Awkward inputs: nulls, empty and very long texts, repeated rows, empty tables, clashing columns; for operators and for each stage."""

import pytest

from scriptorium.llm import decontaminate, hmm, quality, sentencepiece, token_counts

#: Columns of documents, and others whose names are used inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, body string, h bigint, word string, row bigint, component bigint, value string, digest binary, good boolean, label string"
LONG = "der Hund und die Katze " * 4000
TEXTS = [None, "", " \n\t ", "!!! ???", "word", "word", "A" * 30_000, LONG, LONG, "mail me at a.b@c.org or +1 234 567 8901", "two benchmark words stand here as they do there every day and night"]


def frame(spark, rows):
    """Documents from (doc_id, text)."""
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 == 0 else "host/path", None, "x", "y", 7, "w", 1, 2, "v", b"d", None, "l") for k, (i, t) in enumerate(rows)], SCHEMA)


ROWS = [*enumerate(TEXTS), (4, "word"), (4, "another text of the same id"), (None, "no id but text"), (None, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with labels and a benchmark, and one where both are empty."""
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    labels = [(4, 1, 0), (5, 1, 0), (3, 0, None), (None, 0, 1), (99, None, None), (4, 1, 0)]
    items = [(1, "benchmark words stand here as they do there every day and night"), (2, None), (None, "x"), (3, ""), (1, "again")]
    for where, rows, bench in ((full, labels, items), (empty, [], [])):
        spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(full), str(empty)


@pytest.mark.parametrize("stage", range(5))
@pytest.mark.parametrize("where", [0, 1])
def test_stages_on_awkward_documents(spark, tables, stage, where):
    import corpus_pipeline as p

    docs = frame(spark, ROWS)
    name, run = p.STAGES[stage]
    out = run(spark, docs, tables[where])
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    every = sorted((i is None, i or 0) for i, _ in ROWS)
    if name == "MinHash near-dedup":
        # equal texts stay once, under their smallest id; a repeated row once; wordless ones all stay
        assert [i for null, i in got if not null] == [0, 1, 2, 3, 4, 4, 6, 7, 9, 10] and sum(null for null, _ in got) == 2
    elif name == "benchmark decontamination":
        assert got == [x for x in every if where or x != (False, 10)]
    elif name == "quality classifier":
        assert set(got) <= set(every) and (where == 0 or got == every)
    else:
        assert got == every
    if stage < 4:
        assert out.columns == docs.columns
    if name == "PII":
        text = {r.doc_id: r.text for r in out.collect() if r.doc_id not in (4, None)}
        assert "[EMAIL]" in text[9] and "[PHONE]" in text[9] and text[0] is None and text[7] == LONG
    if stage == 4:
        assert {r.doc_id: r.decoded for r in out.collect()}[7] == LONG


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_empty_tables(spark, tables, stage):
    import corpus_pipeline as p

    docs = frame(spark, [])
    for where in tables:
        out = p.STAGES[stage][1](spark, docs, where)
        assert out.count() == 0 and (stage == 4 or out.columns == docs.columns)


def test_pieces_of_repeated_rows_and_of_nothing(spark):
    model = sentencepiece.Model()
    got = sorted((r.id, len(r.ids)) for r in sentencepiece.encode(frame(spark, [(1, "a b"), (1, "a b"), (1, None), (2, LONG)]), model).collect())
    assert got[0] == (1, 0) and got[1] == got[2] == (1, 2) and got[3][1] > 20_000
    assert sentencepiece.encode(frame(spark, []), model).count() == 0
    assert sentencepiece.decode(sentencepiece.encode(frame(spark, []), model), model).count() == 0
    counts = sorted((r.id, r.n_tokens) for r in token_counts.token_counts(frame(spark, [(1, "a b"), (1, "a b"), (1, None), (2, LONG)]), model).collect())
    assert counts == got
    assert token_counts.token_counts(frame(spark, []), model).count() == 0


@pytest.mark.parametrize("pattern_bytes", [1 << 20, 30])
def test_repeated_document_rows_have_a_row_each(spark, pattern_bytes):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(k, " ".join(words[k * 10 : k * 10 + 10])) for k in range(4)], "item_id bigint, text string")
    a, b = " ".join(words[:10]), " ".join(["x", *words[10:20], "y"])
    found = decontaminate.contamination(frame(spark, [(1, a), (1, a), (1, b), (2, "clean"), (None, b), (3, None)]), items, pattern_bytes=pattern_bytes)
    got = sorted((r.id or 0, r.n_words, [(s.s, s.e) for s in r.spans], list(r.items)) for r in found.collect())
    assert got == [(0, 12, [(1, 11)], ["1"]), (1, 10, [(0, 10)], ["0"]), (1, 10, [(0, 10)], ["0"]), (1, 12, [(1, 11)], ["1"]), (2, 1, [], []), (3, 0, [], [])]


def test_scores_of_repeated_rows(spark):
    rows = [(1, "a b a"), (1, "a b a"), (2, "a"), (None, "c"), (3, None), (4, LONG)]
    got = hmm.score(frame(spark, rows), passes=2).collect()
    same = [r for r in got if r.id == 1]
    assert len(got) == len(rows) and len(same) == 2 and same[0] == same[1]
    assert all(r.score < 0 and r.base_score < 0 for r in got)


def test_quality_without_labels_keeps_all(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.classify(frame(spark, ROWS), none).collect()
    assert len(got) == len(ROWS) and all(r.kept for r in got)
