from __future__ import annotations

import numpy as np

from tessera.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.op9_quality(docs, labels)
    assert found.count() == docs.count()
    held = found.join(labels, "doc_id").where("held_out").toPandas()
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    good = held[held["quality"] == 1]
    assert (good["predicted"] == 1).mean() > 0.98
    assert held["score"].between(0, 1).all()


def test_compiled_rules_equal_numpy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 150 and any(len(r.terms) > 1 for r in model.rules)
    measured, names = quality.statistics(docs)
    rows = measured.withColumn("score", model.sql()).toPandas()
    x = {n: rows[n].to_numpy() for n in names}
    want = 1 / (1 + np.exp(-(model.bias + sum(w * r.holds(x) for r, w in zip(model.rules, model.weights, strict=True)))))
    assert np.abs(want - rows["score"]).max() < 1e-9


def test_statistics(spark):
    rows = spark.createDataFrame([("Ab C|d!\nAb 12.\n\nÉ",), ("",), (None,), (" \n ",)], "text string")
    df, names = quality.statistics(rows)
    r = df.collect()
    assert r[0]["__upper"] == 4 / 17 and r[0]["__bars"] == 1 / 5 and r[0]["__shouts"] == 1 / 5 and r[0]["__distinct_words"] == 4 / 5 and r[0]["__distinct_lines"] == 1.0 and r[0]["__words_a_line"] == 5 / 3
    assert all(r[1][n] == 0 and r[2][n] == 0 for n in names)
    assert df.columns == ["text", *names]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "word " * 300000, "x"), (3, "bad", "x"), (3, "bad", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.op9_quality(docs, none).collect()
    assert len(found) == 5 and {r.score for r in found} == {0.5}
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 0), (3, 1, 1), (9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.op9_quality(docs, labels).collect()
    assert len(found) == 5 and len({r.score for r in found if r.doc_id == 3}) == 1
    assert quality.op9_quality(docs.limit(0), labels).count() == 0
