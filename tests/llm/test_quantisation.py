from __future__ import annotations

import numpy as np

from tessera.llm import quantisation as aq


def _truth(rows, every=20, k=20):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    names, x = np.array([g[0] for g in good]), np.stack([g[1] for g in good])
    found = {}
    for i, v in good:
        if i % every == 0:
            s = np.where(names == i, -np.inf, (x * v).sum(1))
            top = [j for j in np.lexsort((names, -s))[:k] if np.isfinite(s[j])]
            found[i] = [(int(names[j]), float(s[j])) for j in top]
    return found


def _rows(n):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    x = (centre[rng.integers(0, 6, n)] + 0.6 * rng.normal(size=(n, 16))).astype(np.float32)
    x[40:70] = x[40]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    bad = [(100000, None), (100020, [0.0] * 16), (100040, [float("nan")] * 16), (100060, [float("inf")] + [1.0] * 15), (100080, [None] + [1.0] * 15), (100100, []), (100120, [1.0]), (None, [1.0] * 16)]
    return rows + bad


def _found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, block int")
    index, books = aq.build(df, **kw)
    return aq.search(index, books, index.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "vec")).collect()


def test_recall_and_ties(spark):
    rows = _rows(3000)
    truth, found = _truth(rows), {}
    for r in sorted(_found(spark, rows, block_rows=700, sample=2000, k=64), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(truth)
    assert all(len(v) == 20 for v in found.values())
    hits = sum(len({a for a, _ in v} & {a for a, _ in truth[q]}) for q, v in found.items())
    assert hits >= 0.98 * 20 * len(truth)
    for q, v in found.items():
        assert v == sorted(v, key=lambda t: (-t[1], t[0]))
        assert all(abs(dict(truth[q]).get(a, s) - s) < 1e-12 for a, s in v)


def test_few_rows_are_exact(spark):
    rows = _rows(90)[:12] + _rows(90)[90:]
    got = {}
    for r in sorted(_found(spark, rows), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [a for a, _ in v] for q, v in _truth(rows).items()}


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert aq.op8_neighbours(df).count() == 0
    assert aq.op8_neighbours(spark.createDataFrame([(0, None)], "vec_id long, embedding array<float>")).count() == 0


def test_more_beams_encode_better():
    x = np.random.default_rng(0).normal(size=(600, 16)).astype(np.float32)
    books = aq.fit(x, m=4, k=32)
    error = [((books.decode(books.encode(x, beam=b)) - x) ** 2).sum() for b in (1, 8)]
    assert error[1] < error[0] < (x**2).sum()


def test_large_vectors_do_not_overflow(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(a) for a in v * 1e20]) for i, v in enumerate(rng.normal(size=(100, 16)))]
    got = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in sorted(aq.op8_neighbours(df).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [a for a, _ in v] for q, v in _truth(rows).items()}


def test_many_copies_of_a_vector(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x[1000:2000] = x[7] * 0.9
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (40, [9.0] * 16)], "vec_id long, embedding array<double>")
    index, q = aq.build(df, block_rows=800, list_rows=500, sample=1500, k=64)
    found, truth = {}, _truth(rows)
    for r in aq.search(index, q, df.where("vec_id % 20 = 0 and vec_id <> 40").selectExpr("vec_id as query_id", "embedding as vec")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    truth = {k: {a for a, _ in v} for k, v in truth.items() if k != 40}
    hits = sum(len(found[k] & (v | {40})) for k, v in truth.items())
    assert hits >= 0.95 * 20 * len(truth) and all(len(v) == 20 for v in found.values())


def test_distances_use_norms(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(2500, 16)) * rng.uniform(0.2, 3, (2500, 1))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index, q = aq.build(df, block_rows=900, list_rows=600, k=64, measure="l2")
    hits = 0
    for r in aq.search(index, q, df.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding as vec"), measure="l2").collect():
        d = ((x - x[r.query_id]) ** 2).sum(1)
        d[r.query_id] = np.inf
        hits += r.vec_id in set(np.argsort(d, kind="stable")[:20].tolist())
        assert abs(r.score + d[r.vec_id]) < 1e-9
    assert hits >= 0.95 * 20 * 50


def test_registered_query_reranks_little(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index, q = aq.build(vectors)
    assert q.depth * 1.5 < 0.1 and 40 < 0.1 * vectors.count()
    x = vectors.toPandas()
    names, m = x["vec_id"].to_numpy(), np.stack(x["embedding"].to_list()).astype(float)
    found = {}
    for r in aq.op8_neighbours(vectors).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for query in names[names % 20 == 0]:
        score = m @ m[names == query][0]
        score[names == query] = -np.inf
        hits += len(found[query] & set(names[np.lexsort((names, -score))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(found) and len(found) == (names % 20 == 0).sum()


def _recall(spark, x, **kw):
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    truth, found = _truth(rows), {}
    for r in sorted(_found(spark, rows, **kw), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = [len({a for a, _ in v} & set(found[q])) / len(v) for q, v in truth.items()]
    return sum(hits) / len(hits), min(hits)


def test_rare_long_vectors_are_found(spark):
    """One row in 200 is 30 times as long, so few are in the sample, and they are nearest to all."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 16))
    x[rng.random(len(x)) < 0.005] *= 30
    mean, least = _recall(spark, x, block_rows=700, list_rows=500, sample=1000, m=4, k=32)
    assert mean >= 0.99 and least >= 0.8


def test_rows_that_drift_are_found(spark):
    """Neighbours of a row are all in one list."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 16)) + 3 * np.sin(np.arange(6000)[:, None] / 6000 * np.arange(1, 17))
    mean, least = _recall(spark, x, block_rows=700, list_rows=200, sample=1000, m=4, k=32)
    assert mean >= 0.98 and least >= 0.5
