from __future__ import annotations

import random

import numpy as np
import pytest

from tessera.llm import attribution
from tessera.llm.sstable import tokenizer_path
from tessera.llm.tokens import Encoder

TEXTS = ["one\ntwo  three\n\n\n four", "", None, "\n", "é日本\n😀 x\x1c\n", "no end", "a\n\n\n\n\nb\n", "w " * 3000 + "\n" + "x" * 500]


def _truth(text, rule):
    text = text or ""
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    spans, at = [], 0
    for x in lines:
        spans.append((at, at + len(x)))
        at += len(x)
    tokens, crossing = [0.0] * len(lines), [0] * len(lines)
    for a, b in Encoder(tokenizer_path()).tokenizer.encode(text, add_special_tokens=False).offsets:
        held = [max(0, min(b, t) - max(a, s)) for s, t in spans]
        first = next(k for k, h in enumerate(held) if h)
        crossing[first] += sum(h > 0 for h in held) > 1
        if rule == "share":
            tokens = [n + h / sum(held) for n, h in zip(tokens, held)]
        else:
            tokens[first if rule == "start" else held.index(max(held))] += 1
    return [(k, len(x), round(tokens[k], 9), crossing[k]) for k, x in enumerate(lines)]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_lines(spark, rule):
    docs = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(TEXTS)] + [(1, "", "row again")], "doc_id long, text string, parts string")
    found = {}
    for r in attribution.section_tokens(docs, rule=rule).collect():
        found.setdefault(r.doc_id, []).append((r.section, r.n_chars, round(r.n_tokens, 9), r.n_crossing))
    for i, t in enumerate(TEXTS):
        assert sorted(found[i if i else None]) == sorted(_truth(t, rule) * (2 if i == 1 else 1)), (i, t)


def test_fields(spark):
    docs = spark.createDataFrame([(1, "a title", None, "the body\n\n")], "doc_id long, title string, note string, body string")
    found = {r.section: r for r in attribution.section_tokens(docs, fields=["title", "note", "body"]).collect()}
    whole = Encoder(tokenizer_path()).ids("a title\n\nthe body\n\n")
    assert [found[f].n_chars for f in ("title", "note", "body")] == [8, 1, 10]
    assert sum(r.n_tokens for r in found.values()) == len(whole)


def test_allocate_random():
    r = random.Random(1)
    for _ in range(200):
        cuts = sorted(r.choices(range(31), k=4))
        borders = np.array([0, *cuts, 30])
        ends = np.array(sorted({*r.sample(range(1, 30), 8), 30}))
        starts = np.concatenate([[0], ends[:-1]])
        for rule in attribution.RULES:
            tokens, _ = attribution.allocate(starts, ends, borders, rule)
            assert abs(tokens.sum() - len(ends)) < 1e-9
            assert all(tokens[k] == 0 for k in range(5) if borders[k] == borders[k + 1])


def test_empty(spark):
    assert attribution.op6_attribution(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {}
    for r in attribution.op6_attribution(docs).collect():
        found.setdefault(r.doc_id, []).append((r.section, r.n_chars, round(r.n_tokens, 9), r.n_crossing))
    for r in docs.collect():
        assert sorted(found[r.doc_id]) == _truth(r.text, "start")
