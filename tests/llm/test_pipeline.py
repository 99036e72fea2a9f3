from __future__ import annotations

import zlib

import numpy as np

import corpus_pipeline
from tessera.llm import mixing, sstable, toxicity
from tessera.llm.tokens import Encoder
from tests.llm.test_decontamination import _shingles
from tests.llm.test_jaccard import _truth

SF = "/root/testdata/sf0.001"


def test_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scored = {r.doc_id: r.predicted for r in toxicity.op4_toxicity(docs, labels).collect()}
    rows = [r for r in docs.collect() if not scored[r.doc_id]]
    least = {d: c for (_, d), _, c in _truth([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if least[r.doc_id] == r.doc_id]
    sets = [_shingles(t) for t in items]
    rows = [r for r in rows if not any(s and len(s & _shingles(r.text)) >= 0.8 * len(s) - 1e-9 for s in sets)]
    left = docs.where(docs.doc_id.isin([r.doc_id for r in rows]))
    copies = {r.doc_id: r.copies for r in mixing.op3_mix(left).collect()}
    assert len(rows) > 20 and set(copies) == {r.doc_id for r in rows}
    coder, at, want = Encoder(sstable.tokenizer_path()), 0, []
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = np.append(coder.tokenizer.encode(r.text, add_special_tokens=False).ids, 0).astype("<u4")
        for _ in range(copies[r.doc_id]):
            want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
    found = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(found, key=lambda r: r[1]) == want


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a text", "en", None, 6), (None, None, None, None, None), (2, "", "en", "s", 0)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
