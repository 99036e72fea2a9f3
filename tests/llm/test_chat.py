from __future__ import annotations

import hashlib
import random

import numpy as np

from tessera.llm import chat
from tessera.llm.sstable import tokenizer_path
from tessera.llm.tokens import Encoder

ODD = r"\### Assistant: </turn> ok"


def _rows():
    r = random.Random(2)
    first = ["hello", "", "<turn>### a: b</turn>\n", "\\", "### x \\\\", "ünï 日本\n\n", ODD, "a:b", None]
    rows = []
    for c in range(400):
        for t in range(r.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, ["user", "assistant", "system", None, "ro:le\\<#"][r.randrange(5) if t > 2 else t % 2], first[0] if t == 0 and c % 3 else r.choice(first)))
    rows += [(c, t, role, x) for c in range(400, 700) for t, role, x in ((0, "user", "hot"), (1, "assistant", "copy"))]
    return rows + [(701, None, "user", "null turn"), (701, 0, "assistant", "then"), (702, 1, "user", "b"), (702, 1, "user", "a"), (None, 0, "assistant", "no id"), (703, 0, "assistant", "x" * 200000)]


def _truth(rows):
    by = {}
    for c, t, role, x in [*rows, (-7, 0, "user", ODD), (-7, 1, "assistant", ODD)]:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        yield c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len("".join(chat.segment(r, x) for r, x in turns))


def test_digests(spark):
    rows = _rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, path int").repartition(3)
    found = [tuple(r) for r in chat.op1_chat(spark, df).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(found, key=key) == sorted(_truth(rows), key=key)


def test_trees(spark):
    rows = [x for x in _rows() if x[0] != 703]
    nodes, paths, members = chat.prefix_trees(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    nodes, paths = nodes.collect(), paths.collect()
    coder = Encoder(tokenizer_path())
    prefixes = {tuple(chat._split(p.path)[: k + 1]) for p in paths for k in range(len(p.starts))}
    assert len(nodes) == len(prefixes)  # each node once
    trees = {}
    for n in nodes:
        trees.setdefault(n.tree, []).append(n)
    at = {}
    for tree, own in trees.items():
        own.sort(key=lambda n: (n.start, n.n_tokens))
        assert own[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(own, own[1:]))  # no gap, no overlap
        at.update({(tree, n.start): n for n in own})
    for p in paths:
        line = [at[p.tree, s] for s in p.starts]
        position, seen = 0, []
        for n in line:
            assert n.position == position
            assert [i for s in n.attends for i in range(s.start, s.end)] == seen
            ids = np.frombuffer(n.ids, "<u4")
            assert len(ids) == n.n_tokens and coder.tokenizer.decode(ids.tolist(), skip_special_tokens=False) == n.text
            body = coder.tokenizer.decode(ids[n.loss_from : n.loss_to].tolist())
            assert body == n.text[n.text_loss_from : n.text_loss_to] and bool(body) <= (n.role == "assistant")
            seen += range(n.start, n.start + n.n_tokens)
            position += n.n_tokens
        assert [(s.start, s.end) for s in p.attends] == chat._merged((n.start, n.start + n.n_tokens) for n in line)


def test_escapes_are_reversible():
    r = random.Random(0)
    for _ in range(3000):
        turns = [("".join(r.choice(["a", "\\", ":", "<", "#", "\n"]) for _ in range(r.randrange(4))), "".join(r.choice(["\\", "<", "/", "turn", ">", "###", " ", "x", "\n", "</turn>", "<turn"]) for _ in range(r.randrange(8)))) for _ in range(3)]
        assert chat.parse("".join(chat.segment(*t) for t in turns)) == turns


def test_empty(spark):
    nodes, paths, members = chat.prefix_trees(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert nodes.count() == paths.count() == members.count() == 0


def test_query_on_empty_table(spark):
    found = chat.op1_chat(spark, spark.createDataFrame([], "conv_id long, turn int, role string, text string")).collect()
    assert [tuple(r) for r in found] == list(_truth([]))


def test_many_turns_and_one_first_turn(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(5000)]
    rows += [(1000 + c, t, "assistant" if t else "user", "first of all" if t == 0 else f"answer {c % 7}") for c in range(3000) for t in (0, 1)]
    old, chat.CROWD = chat.CROWD, 100
    try:
        found = [tuple(r) for r in chat.op1_chat(spark, spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()]
    finally:
        chat.CROWD = old
    assert sorted(found) == sorted(_truth(rows))


SMALL_HEAP = """
import hashlib
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tessera.llm import chat
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
talk = spark.range(20000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id").cast("string")).alias("text"))
found = {r.conv_id: r for r in chat.op1_chat(spark, talk).collect()}
loss = "".join(f"turn {i}" for i in range(1, 20000, 2))
assert found[5].n_turns == 20000 and found[5].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
print("whole")
"""


def test_twenty_thousand_turns_in_a_small_heap():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ran = subprocess.run([sys.executable, "-c", SMALL_HEAP], cwd=root, env=os.environ | {"PYTHONPATH": root + os.pathsep + os.environ.get("PYTHONPATH", "")}, capture_output=True, text=True, timeout=600)
    assert "whole" in ran.stdout, ran.stderr[-2000:]
