"""Stages of the pipeline on tables whose further columns have the names that operators use themselves."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import quality, toxicity

SF = "/root/testdata/sf0.001"
NAMES = ["y", "id", "__id", "__score", "__size", "__k", "__print", "__hit", "__source", "__doc", "__own", "print", "node", "hash"]


def test_clashing_names_pass_through(spark):
    rows = [(1, "some words in a text", "en", "a", 20, *range(14)), (1, "some words in a text", "en", "a", 20, *range(14)), (1, "other words of that id", "en", "b", 22, *range(14)), (None, None, None, None, None, *range(14)), (2, "", "en", "a", 0, *range(14)), (3, "word " * 100_000, "en", "b", 500_000, *range(14))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert all(tuple(r)[5:] == tuple(range(14)) for r in found), name
        if name == "near copies":
            assert sorted(str(r.doc_id) + str(r.text)[:5] for r in found) == ["1other", "1some ", "2", "3word ", "NoneNone"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert toxicity.op4_toxicity(docs, labels).count() == quality.op9_quality(docs, labels).count() == len(rows)


def test_labels_are_drawn_among_the_documents(spark):
    docs = spark.createDataFrame([(i, f"{'rude' if i % 2 else 'nice'} text {i % 7}") for i in range(900, 1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, most=(20, 20))
    assert len(model.weights) > 0
