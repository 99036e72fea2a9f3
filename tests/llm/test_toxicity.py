from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity

SF = "/root/testdata/sf0.1"


def _auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = toxicity.op4_toxicity(docs, labels)
    assert found.count() == docs.count()
    held = found.join(labels, "doc_id").where("held_out").toPandas()
    assert _auc(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.95
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    assert held["score"].between(0, 1).all()


def test_occurrences_equal_brute_force():
    texts = ["abcdefg" * 3, "", None, "ab", "Éa 日本語 x" * 50, "same", "same"]
    toxicity_window, toxicity.WINDOW = toxicity.WINDOW, 64
    try:
        slot = np.arange(1 << toxicity.BITS, dtype=np.int32)
        found = toxicity.occurrences(texts, slot)
    finally:
        toxicity.WINDOW = toxicity_window
    want = set()
    for k, t in enumerate(texts):
        points = np.array([ord(c) for c in (t or "").lower()], dtype=np.uint32)
        for n, b in toxicity._buckets(np.append(points, np.zeros(9, dtype=np.uint32))):
            want |= {k * (1 << toxicity.BITS) + int(x) for x in b[: max(0, len(points) - n + 1)]}
    assert want == set(found.tolist())
    assert toxicity.document_counts(texts).sum() == len(want)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "word " * 300000, "x"), (3, "bad", "x"), (3, "bad", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.op4_toxicity(docs, none).collect()
    assert len(found) == 5 and {r.score for r in found} == {0.5}
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 0), (3, 0, 1), (3, 0, 0), (9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.op4_toxicity(docs, labels).collect()
    assert len(found) == 5 and len({r.score for r in found if r.doc_id == 3}) == 1
    assert toxicity.op4_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.without_toxic(docs, none).columns == docs.columns


def test_scores_read_texts_only(spark):
    docs = spark.createDataFrame([(i, f"{'rude' if i % 3 == 0 else 'nice'} text {i % 11}", "en", "s") for i in range(300)], "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    found = toxicity.op4_toxicity(docs, labels).join(docs, "doc_id").collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in found)
    assert len({r.text for r in found}) == len({(r.text, r.score) for r in found})
