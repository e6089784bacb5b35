from pathlib import Path

import pytest

import corpus_pipeline
from quillmark.llm.toxicity import learn, toxicity
from tests.llm.test_minhash import brute

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the shared tables are not here")


def test_stages(spark):
    """Every stage's result against plain Python over its own input."""
    d = str(DATA)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    model = learn(docs, spark.read.parquet(f"{d}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity(docs, model).where("predicted = 1").collect()}
    benchmark = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = held, stage(spark, docs, d)
        if name == "packing":
            got = docs.collect()
            assert {r.doc_id for r in got} == set(before) and docs.count() == len(got)
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        held = {r.doc_id: r.text for r in rows}
        assert len(held) == len(rows) and held.items() <= before.items()
        if name == "toxicity":
            assert set(before) - set(held) == toxic
        elif name == "exact_dedup":
            assert set(held) == set({t: i for i, t in sorted(before.items())}.values())
        elif name == "near_dedup":
            assert set(held) == {i for i, (_, c) in brute(before.items(), 5).items() if i == c}
        else:
            leaks = {i for i, t in before.items() if any(b in " ".join(t.lower().split()) for b in benchmark)}
            assert leaks and not leaks & set(held) and len(before) - len(held) <= len(leaks) + 2


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(DATA))
        assert docs.count() == 0


def test_rows_are_judged_one_by_one(spark, repeated):
    docs = corpus_pipeline.drop_copies(spark, repeated, "")
    assert docs.columns == ["doc_id", "text", "a.b"]
    assert sorted((r["doc_id"] or 0, r["a.b"]) for r in docs.collect()) == [(1, "y"), (2, "z"), (3, "u"), (7, "e"), (8, "s")]
