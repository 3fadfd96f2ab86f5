import pytest

import __spark_entry__ as contract

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_work_on_each_others_rows(spark, data, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, data)
        assert out.columns == docs.columns, name
        path = corpus_pipeline.written(out, f"test-{name}")
        if name != "mixing":
            assert path.join(kept, docs.columns, "left_semi").count() == path.count() <= kept.count()
        kept = path
    name, stage = corpus_pipeline.STAGES[-1]
    out = stage(spark, kept, data).collect()
    assert len(out) == kept.count() and all(r["ids"][0] == 1 and r["ids"][-1] == 2 for r in out)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(r["decoded"] == texts[r["doc_id"]] for r in out)


def test_stages_on_odd_and_empty_tables(spark, data, odd, docs):
    wide = odd.select("doc_id", "text").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "1 AS score")
    for start in (wide, wide.limit(0)):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, data)
        assert kept.count() <= start.count() * 20


def test_pipeline_is_registered():
    assert "pipeline" in contract.queries() and len(corpus_pipeline.STAGES) == 5
