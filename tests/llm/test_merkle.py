from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tessera.llm import merkle


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(row, text):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[2], row[3], row[4], text)))


def _tree(nodes):
    """The root, and for each node the texts left and right of its path."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = p - p % 3
            paths[k].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 3])))
        nodes = [_h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        at = [p // 3 for p in at]
    return nodes[0], paths


def _truth(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(r, r[1]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: x[:3])
    lower = {s: _tree([x[2] for x in trees[s]]) for s in order}
    root, upper = _tree([lower[s][0] for s in order])
    out = []
    for s, above in zip(order, upper):
        for (_, _, leaf, r), path in zip(trees[s], lower[s][1]):
            path = path + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = _leaf(r, r[1].replace("\n", "")) if tampered else leaf
            for left, right in path:
                node = _h(left + node + right)
            out.append((r[0], leaf, lower[s][0], root, _h("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def _rows(n):
    r = random.Random(n)
    rows = [(k, r.choice(["", "a\nb", "längér\n\ntext", "x" * 20_000, "plain"]), r.choice(["s", "s", "s", "é", "z", "Z", None, ""]), r.choice(["en", None]), r.choice([None, 7, 12])) for k in range(n)]
    return rows + [(n + 5, None, "only", None, None), (3, "another", "s", "en", 1), (None, "a\nb", "s", "en", 1), (None, None, None, None, None), *rows[:4], *rows[:4]]


@pytest.mark.parametrize(("levels", "n"), [(1, 60), (2, 300), (6, 40)])
def test_equals_brute_force(spark, monkeypatch, levels, n):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = _rows(n)
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, source string, lang string, n_chars long, at int, tree string")
    found = sorted(map(tuple, merkle.op12_merkle(df).collect()), key=str)
    assert found == _truth(rows)
    assert not all(x[-1] for x in found)


def test_manifest_and_empty(spark):
    rows = _rows(30)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    m = merkle.manifest(df)
    assert m.root == _truth(rows)[0][3]
    assert {r.source: r.n for r in m.sources.collect()}["only"] == 1
    assert all(r.verified and r.claim == r.leaf for r in merkle.proofs(m).collect())
    assert merkle.op12_merkle(df.limit(0)).collect() == []
    assert merkle.manifest(df.limit(0)).root is None


def test_one_row(spark):
    df = spark.createDataFrame([(5, "a", "s", "en", 1)], "doc_id long, text string, source string, lang string, n_chars long")
    row = merkle.op12_merkle(df).collect()[0]
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == _h("") and row.verified
