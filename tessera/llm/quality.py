"""Quality scores by a sparse rule ensemble (operator 9).

Statistics of a text are Spark columns. Small regression trees are boosted on them
for a bounded sample of labelled rows; every path from a root to a node is a rule,
a conjunction of thresholds. A logistic regression with an absolute-value penalty
on the rules' outcomes keeps a few of them, and those become one Spark column
expression, so that scoring needs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, labelled


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    """Characters of a text that match a class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(docs: DataFrame, column: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with a double column __<name> for each statistic of the text, and those names. Shares of nothing are 0; a null text counts as an empty one."""
    text = F.coalesce(F.col(column), F.lit(""))
    base = docs.withColumn("__text", text)
    base = base.withColumn("__words", F.filter(F.split("__text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x != ""))
    t, words, lines = F.col("__text"), F.size("__words"), F.size("__lines")
    chars = F.length(t)
    found = {
        "log_chars": F.log1p(chars),
        "words_a_line": _share(words, lines),
        "chars_a_word": _share(chars, words),
        "distinct_words": _share(F.size(F.array_distinct("__words")), words),
        "distinct_lines": _share(F.size(F.array_distinct("__lines")), lines),
        "upper": _share(_count(t, r"\p{Lu}+"), chars),
        "letters": _share(_count(t, r"\p{L}+"), chars),
        "digits": _share(_count(t, "[0-9]+"), chars),
        "stops": _share(_count(t, "[.,]+"), words),
        "shouts": _share(_count(t, "[!?]+"), words),
        "bars": _share(_count(t, r"\|+"), words),
        "signs": _share(_count(t, r"[#$%&*+<>=@^_~{}\[\]\\/]+"), words),
    }
    names = [f"__{k}" for k in found]
    out = base.withColumns({f"__{k}": c.cast("double") for k, c in found.items()}).drop("__text", "__words", "__lines")
    return out, names


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether it lies above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, [(x[n] > c) if above else (x[n] <= c) for n, above, c in self.terms])

    def sql(self) -> Column:
        return reduce(lambda a, b: a & b, [(F.col(n) > c) if above else (F.col(n) <= c) for n, above, c in self.terms])


def _tree(x: np.ndarray, cuts: list[np.ndarray], codes: np.ndarray, target: np.ndarray, depth: int, least: int) -> tuple[list[tuple], np.ndarray]:
    """A regression tree: its paths [(feature, above, cut), ...] to all nodes but the root, and its prediction."""
    paths, out = [], np.zeros(len(target))

    def grow(rows: np.ndarray, path: tuple) -> None:
        if path:
            paths.append(path)
        best = None
        if len(path) < depth and len(rows) >= 2 * least:
            t = target[rows]
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                sums = np.bincount(codes[rows, j], weights=t, minlength=len(c) + 1).cumsum()[:-1]
                n = np.bincount(codes[rows, j], minlength=len(c) + 1).cumsum()[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((n >= least) & (len(rows) - n >= least), sums**2 / n + (t.sum() - sums) ** 2 / (len(rows) - n), -np.inf)
                k = int(gain.argmax())
                if np.isfinite(gain[k]) and gain[k] > t.sum() ** 2 / len(rows) + 1e-9 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k)
        if best is None:
            out[rows] = target[rows].mean()
            return
        _, j, k = best
        low = codes[rows, j] <= k
        grow(rows[low], (*path, (j, False, float(cuts[j][k]))))
        grow(rows[~low], (*path, (j, True, float(cuts[j][k]))))

    grow(np.arange(len(target)), ())
    return paths, out


def extract_rules(x: dict[str, np.ndarray], y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, least: int = 10) -> list[Rule]:
    """Distinct rules of boosted trees; one of two complementary rules is enough."""
    names = list(x)
    matrix = np.stack([x[n] for n in names], axis=1)
    cuts = [np.unique(np.quantile(matrix[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(len(names))]
    cuts = [c[c < matrix[:, j].max()] for j, c in enumerate(cuts)]
    codes = np.stack([np.searchsorted(c, matrix[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score, rules, seen = np.zeros(len(y)), [], set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        paths, out = _tree(matrix, cuts, codes, y - p, depth, min(least, max(1, len(y) // 20)))
        score += rate * out / max(1e-3, float((p * (1 - p)).mean()))
        score = np.clip(score, -8, 8)
        for path in paths:
            rule = Rule(tuple((names[j], above, c) for j, above, c in path))
            outcome = rule.holds(x)
            key = outcome.tobytes() if outcome[0] else (~outcome).tobytes()
            if key not in seen and 0 < outcome.sum() < len(y):
                seen.add(key)
                rules.append(rule)
    return rules


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with an absolute-value penalty on standardised columns, by accelerated proximal steps."""
    mean, spread = z.mean(0), np.maximum(z.std(0), 1e-3)
    a = np.ascontiguousarray((z - mean) / spread)
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        top = np.linalg.norm(v) or 1.0
        v /= top
    rate = 1 / (0.25 * (top / len(y) + 1))
    w = np.zeros(a.shape[1])
    b = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    aw, ab, t = w, b, 1.0
    for _ in range(steps):
        off = (1 / (1 + np.exp(-np.clip(a @ aw + ab, -40, 40))) - y) / len(y)
        nw = aw - rate * (a.T @ off)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb, nt = ab - rate * off.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        aw, ab = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w / spread, float(b - (w / spread) @ mean)


class Ensemble:
    """rules with their weights, and a bias."""

    def __init__(self, rules: list[Rule], weights: list[float], bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    def sql(self) -> Column:
        """The score as a column expression over the statistics."""
        total = reduce(lambda a, b: a + b, [F.when(r.sql(), F.lit(w)).otherwise(0.0) for r, w in zip(self.rules, self.weights, strict=True)], F.lit(self.bias))
        return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", *, most: tuple[int, int] = (6000, 14000), penalty: float = 2e-3, **trees: float) -> Ensemble:
    """An ensemble from at most most[0] rows of label 0 and most[1] of label 1 that aren't held out. Without rows of both labels it gives the share of label 1 to any text, 0.5 without rows."""
    sample = labelled(docs, labels, target, most, {"text": "text"})
    measured, names = statistics(sample)
    rows = measured.select("y", *names).toPandas()  # sum(most) rows of numbers
    y = rows["y"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Ensemble([], [], float(np.log(share / (1 - share))))
    rows = rows.sort_values(names, kind="stable")
    y, x = rows["y"].to_numpy(dtype=float), {n: rows[n].to_numpy(dtype=float) for n in names}
    rules = extract_rules(x, y, **trees)
    if not rules:
        return Ensemble([], [], float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    weights, bias = lasso(np.stack([r.holds(x) for r in rules], axis=1).astype(float), y, penalty)
    kept = [k for k in range(len(rules)) if abs(weights[k]) > 1e-6]
    return Ensemble([rules[k] for k in kept], [float(weights[k]) for k in kept], bias)


def op9_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted (1 from 0.3 on). Null texts score as empty ones; rows with a null doc_id are never held out; repeated rows score alike; further columns are ignored."""
    model = train(docs, labels)
    measured, names = statistics(docs.select("doc_id", "text"))
    scored = measured.select("doc_id", held_out().alias("held_out"), *names).select("doc_id", "held_out", model.sql().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
