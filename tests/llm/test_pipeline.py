"""The pipeline on whole small tables: columns, decisions and the packing of what is left."""

import pytest

import corpus_pipeline
from lakeloom.llm import common, toxicity


def test_pipeline(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns, seen = docs.dtypes, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, sf), "test")
        assert out.dtypes == columns and 0 < out.count() <= seen
        assert out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        docs, seen = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert packed.groupBy("bin_id").sum("n_tokens").where("`sum(n_tokens)` > 2048").count() == 0
    common.release(spark, "test")


def test_pipeline_of_odd_rows(spark, sf, monkeypatch):
    """Nulls, empty texts, repeated rows, an id with two texts, and an empty table, in every stage."""
    monkeypatch.setattr(toxicity, "train", lambda documents, labels: toxicity.Network())
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "text " * 30, "en", "s", 5), (3, "same words here", "en", "s", 15), (3, "same words here", "en", "s", 15), (3, "another text", "en", "s", 12), (4, "long " * 5000, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, frame, sf).dtypes == docs.dtypes
            assert stage(spark, frame, sf).count() <= frame.count()
        packed = corpus_pipeline.STAGES[4][1](spark, frame, sf)
        assert packed.count() >= frame.count() and packed.where("n_tokens > 2048").count() == 0


def test_toxicity_learns_from_rejected_documents(spark, sf, monkeypatch):
    class Fitted(Exception):
        pass

    def fit(docs, y):
        raise Fitted(len(y), int(y.sum()))

    monkeypatch.setattr(toxicity, "fit", fit)
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    seen = []
    for left in (docs, docs.join(labels.where("toxic = 1 or quality = 0"), "doc_id", "left_anti")):
        with pytest.raises(Fitted) as found:
            corpus_pipeline.keep_civil(spark, left, sf)
        seen.append(found.value.args)
    assert seen[0] == seen[1] and seen[0][1] > 0
