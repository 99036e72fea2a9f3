from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from tessera.llm import jaccard


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def _least(docs):
    """doc_id: the smallest doc_id reachable by links of 0.8 of 5-word shingles, by comparing all pairs."""
    up = {d: d for d, _ in docs}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    sets = [(d, _shingles(t)) for d, t in docs]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x & y and 5 * len(x & y) >= 4 * len(x | y):
                u, v = sorted((root(a), root(b)))
                up[v] = u
    return {d: root(d) for d, _ in docs}


def _docs(seed):
    """Families of a text with scattered edits, and of one cut at an end, around and between both thresholds."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    docs = []
    for f in range(40):
        base = [word() for _ in range(r.choice([9, 24, 104, 304, 604]))]
        docs.append(" ".join(base))
        for _ in range(3):
            if f % 2:
                docs.append(" ".join(base[: round(len(base) * r.uniform(0.76, 0.9))]))
            else:
                at = r.sample(range(len(base)), max(1, round(len(base) * r.uniform(0.019, 0.024))))
                docs.append(" ".join(word() if i in at else w for i, w in enumerate(base)))
    return list(zip(r.sample(range(1000), len(docs)), docs))


def test_stage_equals_brute_force(spark):
    docs = _docs(7)
    rows = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, rows, "").collect())
    least = _least(docs)
    assert kept == sorted(d for d in least if least[d] == d)


def test_stage_drops_a_text_cut_at_the_end(spark):
    words = [f"w{i}" for i in range(204)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:166]))]
    rows = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(_shingles(docs[1][1])) / len(_shingles(docs[0][1])) == 0.81
    assert [r.doc_id for r in corpus_pipeline.drop_copies(spark, rows, "").collect()] == [1]


def test_signatures_meet_at_four_fifths():
    r = random.Random(1)
    for k in range(1000):
        n = r.choice([6, 7, 8, 15, 16, 17, 31, 33, 64, 100, 250])
        x = set((np.random.default_rng(k).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)).tolist())
        y = set(x)
        for _ in range(r.randrange(0, n // 4 + 2)):
            y.discard(r.choice(sorted(y))) if r.random() < 0.5 else y.add(r.getrandbits(64))
        if x != y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = (jaccard.signatures(np.array(sorted(s), dtype=np.uint64), 80).tolist() for s in (x, y))
            assert set(a) & set(b)
