"""Each stage of the pipeline on its own input, and the whole run."""

import corpus_pipeline
from casegraph.llm import simhash
from tests.llm.test_likeness import alike, roots
from tests.llm.test_simhash import components, plain_fingerprint


def test_stages_and_run(spark, sf_dir, documents):
    docs, sizes = documents, [documents.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir).cache()
        sizes.append(out.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents.columns, name
            assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}
        if name == "simhash_dedup":
            prints = [(r["doc_id"], plain_fingerprint(r["text"], 5)) for r in docs.collect()]
            firsts = set(components(prints))
            rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in firsts]
            assert {r["doc_id"] for r in out.collect()} == roots([i for i, _ in rows], alike(rows))
        docs = out
    assert sizes[1] >= 0.98 * sizes[0] and sizes[1] >= sizes[2] > sizes[3] > sizes[4]
    kept = {r["doc_id"] for r in docs.collect()}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in whole.collect()} == kept
    assert whole.count() == sizes[-1]


def test_stages_of_an_empty_table(spark, sf_dir, documents):
    docs = documents.where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        docs = docs if out.columns != documents.columns else out


def test_stages_of_odd_rows(spark, sf_dir, odd):
    """Null ids and texts, repeated rows, very long texts and clashing columns pass every stage."""
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == odd.columns
    assert simhash.one_per_group(docs).count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
