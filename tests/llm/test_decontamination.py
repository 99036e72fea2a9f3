from __future__ import annotations

import random
import re

import duckdb

from tessera.llm import decontamination


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _shingles(text, n):
    w = _words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def _truth(docs, items):
    out = {}
    for d, t in docs:
        every = [_shingles(t, n) for n in range(6)]
        for i, x in items:
            n = min(5, len(_words(x)))
            own, s = every[n], _shingles(x, n) if n else set()
            if s and len(s & own) >= 0.8 * len(s) - 1e-9:
                out[d, i] = max(out.get((d, i), (0, 0)), (len(s & own) / len(s), len(s & own)))
    return out


def _data():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcde") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(r.choice([4, 5, 6, 9, 30, 80])))) for k in range(30)] + [(90, None), (91, ""), (92, "Over Lap one two three four"), (93, "Over"), (94, "LAP  one"), (95, "four y"), (96, "y four"), (97, "four")]
    docs = []
    for k in range(300):
        body = [word() for _ in range(r.choice([0, 5, 50, 800]))]
        if k % 3:
            passage = items[r.randrange(30)][1].split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                passage[r.randrange(len(passage))] = word()
            at = r.randrange(len(body) + 1)
            body[at:at] = passage
        docs.append((k, r.choice([" ", "\n", " \t"]).join(body)))
    docs += [(300, None), (301, ""), (302, "x OVER lap  one two three FOUR y"), (5, docs[5][1]), (None, items[5][1]), (None, items[6][1]), (7, "another text of this id " + items[8][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = _data()
    d = spark.createDataFrame([(*x, "s", 1) for x in docs], "doc_id long, text string, item_id string, print int")
    i = spark.createDataFrame([(*x, 2) for x in [*items, items[3]]], "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id): (r.containment, r.n_shared) for r in decontamination.op7_decontamination(d, i).collect()}
    want = _truth(docs, items)
    assert len(want) > 100
    assert found == {k: (round(a, 9), b) for k, (a, b) in want.items()}
    kept = decontamination.without_items(d, i)
    bad = {(x, t) for x, t in docs if _truth([(x, t)], items)}
    assert kept.columns == d.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(str(x) for x in docs if x not in bad)


def test_short_items(spark):
    own = [(1, "two"), (2, "One\ttwo"), (3, "two one"), (4, "a b c d"), (5, " "), (6, "x y")]
    items = spark.createDataFrame(own, "item_id long, text string")
    docs = spark.createDataFrame([(1, "one TWO"), (2, "a b c d"), (3, "z a b c"), (4, None), (5, "two " * 20_000 + "one"), (6, "xx yy x  y" + " w" * 9), (7, "x_y y x")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id, r.n_shingles) for r in decontamination.op7_decontamination(docs, items).collect()}
    assert found == {(1, 1, 1), (1, 2, 1), (2, 4, 1), (5, 1, 1), (5, 3, 1), (6, 6, 1)}
    con = duckdb.connect()
    for name, rows in (("benchmark", items.toPandas()), ("documents", docs.toPandas())):
        con.register(name, rows)
    assert {x[:3] for x in con.sql(decontamination.ORACLE).fetchall()} == found


def test_empty(spark):
    docs, items = _data()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.op7_decontamination(d.limit(0), i).count() == 0
    assert decontamination.op7_decontamination(d, i.limit(0)).count() == 0


def test_plan_is_native(spark):
    docs, items = _data()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = decontamination.op7_decontamination(d, i)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
