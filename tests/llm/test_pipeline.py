from collections import Counter

import corpus_pipeline
from lattica.llm import quality, simhash


def test_stages_over_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert kept.columns == columns and 0 < kept.count() <= before
        ids = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        left = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
        if name == "quality_rules":
            assert set(left) == {i for i, t in ids.items() if quality.passes(quality.Text(t), quality.RULES)}
        if name == "simhash_dedup":
            assert set(left) == {r.doc_id for r in simhash.near_duplicates(docs).collect() if r.doc_id == r.component_id}
        if name == "suffix_dedup":
            assert set(left) == set(ids)
        else:
            assert all(left[i] == ids[i] for i in left)
        docs, before = kept, kept.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert {p.doc_id for p in pieces} == set(left)
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    sizes = lambda rows: Counter((p.doc_id, p.doc_tokens) for p in rows if p.start == 0)
    assert sizes(again) == sizes(pieces)


def test_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()
