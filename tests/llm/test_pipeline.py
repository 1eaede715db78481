"""The pipeline's stages against what each should do to its own input, and the registered queries."""

import re

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data():
    from pathlib import Path

    if not Path(DATA).is_dir():
        pytest.skip("no test tables here")
    return DATA


def test_stages(spark, data):
    import corpus_pipeline as p
    from scriptorium.llm import sentencepiece
    from tests.llm.test_operators import brute_components, brute_hits, brute_spans

    assert [name for name, _ in p.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    kept = []
    for _, stage in p.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept[0] for i in good) >= 0.95 * len(good) and sum(i in kept[0] for i in bad) <= 0.2 * len(bad)
    ids = sorted(kept[0])
    part = brute_components([kept[0][i] for i in ids], 5)
    assert set(kept[1]) == {i for k, i in enumerate(ids) if part[k][1] == k}
    assert set(kept[2]) == {i for i, t in kept[1].items() if not brute_hits(t, items)[1]}
    assert set(kept[3]) == set(kept[2]) and not any(brute_spans(t) for t in kept[3].values())
    last = {r.doc_id: r for r in p.STAGES[4][1](spark, docs, data).collect()}
    import sentencepiece as sp

    lib = sp.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    assert {i: r.ids for i, r in last.items()} == {i: lib.encode(t) for i, t in kept[3].items()}
    assert all(r.decoded == kept[3][i] for i, r in last.items())


def test_each_operator_has_a_query():
    import __spark_entry__ as e

    names = [m[1] for q in e.queries() if (m := re.match(r"op(\d+)_", q))]
    assert sorted(map(int, names)) == list(range(1, 11)) and "pipeline" in e.queries()
