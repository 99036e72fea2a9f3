from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tessera.llm import divergence


def _terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _truth(rows, least=30, most=50):
    rows = [(lang or "", source or "", _terms(text)) for _, text, source, lang in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs, total, groups = Counter(), Counter(), {}
        for _, source, words in own:
            docs.update(set(words))
            total.update(words)
            groups.setdefault(source, Counter()).update(words)
        kept = sorted(t for t, n in docs.items() if n >= least)
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))
        q = {t: share(total[t], sum(total[x] for x in kept)) for t in kept}
        p = {s: {t: share(c[t], sum(c[x] for x in kept)) for t in kept} for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]):
                    out.append((lang, s, part, item, v, k + 1))
    return sorted(out)


def _rows(n, seed=1):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("x", "Y", "é", "ßß", "𝒳")]
    rows = []
    for k in range(n):
        lang, source = r.choice(["en", "en", "en", "de", None]), r.choice(["hot", "hot", "hot", None, "", *(f"s{i}" for i in range(9))])
        rows.append((k, " ".join(r.choice(words[: 20 + 10 * (k % 4)]) for _ in range(r.choice([0, 3, 30]))) + r.choice(["", "1 2-3_", "don't\x00a`b"]), source, lang))
    return rows + [(n, None, "bare", "en"), (n, "... 12", "dots", "xx"), (n, "solo words", "one", "xx"), *rows[:5]]


SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.mark.parametrize(("chunk", "span", "block"), [(4096, 32, 64), (4, 2, 3), (7, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, chunk, span, block):
    for name, value in (("CHUNK", chunk), ("SPAN", span), ("BLOCK", block), ("HELD", 50)):
        monkeypatch.setattr(divergence, name, value)
    rows = _rows(500)
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA + ", term int, count int")
    found = sorted(map(tuple, divergence.op11_divergence(df).collect()))
    want = _truth(rows)
    assert sum(x[2] == "term" for x in want) > 50
    assert found == want


def test_long_text_and_empty(spark):
    rows = [*_rows(200, 2), (9, "Long wörd " * 200_000, "s1", "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, divergence.audit(df, least=5, most=3).collect())) == _truth(rows, 5, 3)
    assert divergence.op11_divergence(df.limit(0)).collect() == []
    assert divergence.op11_divergence(df.where("lang = 'xx'")).where("part = 'term'").count() == 0


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(10**13, 10**14, 3)], "c long, n long, v long")
    assert df.selectExpr(divergence._share("c", "n", "v")).first()[0] == 1 + 10**9 * (10**13 + 5) // (10**14 + 15)
