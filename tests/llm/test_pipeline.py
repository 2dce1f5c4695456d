"""The corpus pipeline: each stage on its own input, on awkward rows and on nothing."""

import pytest

import corpus_pipeline
from zonelens.llm import near_dup, packing, quality, secrets_forest, toxicity

from .conftest import SF

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dup", "secrets", "packing"]


@pytest.mark.parametrize("name", list(STAGES))
def test_awkward_and_empty(spark, awkward, nothing, name):
    for docs in (awkward, nothing):
        out = STAGES[name](spark, docs, SF)
        rows = out.collect()
        if name == "packing":
            assert out.columns == packing.PACKED.replace(" long", "").split(", ")
        else:
            assert out.dtypes == docs.dtypes
        assert bool(rows) <= (docs is awkward)


def test_run_equals_its_operators(spark, documents, labels):
    judged = {r.doc_id for r in quality.judge(documents, quality.train(documents, labels)).where("kept").collect()}
    docs = corpus_pipeline.quality_rules(spark, documents, SF)
    assert {r.doc_id for r in docs.collect()} == judged
    model = toxicity.train(docs, labels, allowed=lambda d: ~corpus_pipeline.held_out(d))
    clean = {r.doc_id for r in toxicity.score(docs, model).where("score < 0.7").collect()}
    docs = corpus_pipeline.toxic_documents(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} == clean
    one = {r.doc_id for r in near_dup.classes(docs, near_dup.STAGE).where("kept").collect()}
    docs = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} == one
    redacted = {r.doc_id: r.text for r in secrets_forest.redact(docs).collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == redacted.keys()
    by_doc = {}
    for r in rows:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
    assert by_doc == {r.doc_id: r.doc_tokens for r in rows}


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[1:]])
def test_stages_free_what_those_before_have_left(spark, nothing, monkeypatch, stage):
    class Freed(Exception):
        pass

    def free(session):
        assert session is spark
        raise Freed

    monkeypatch.setattr(corpus_pipeline, "free_unused", free)
    with pytest.raises(Freed):
        stage(spark, nothing, "unread")
