r"""Operator 4: a quality classifier of sparse rules.

Shallow decision trees are grown over text statistics of a bounded labelled
sample; every path from a root to a node becomes a rule, a conjunction of
thresholds. A logistic model with lasso weights over the rules (and nothing else)
keeps few of them, and these are compiled into one Spark column expression, so
scoring runs inside Spark's generated code over the whole table.

Statistics are Spark columns of the whole text only: labels, language, source
and id are never inputs of a score. The sample is the ``SAMPLE`` labelled rows with the smallest
hash of their id among those allowed (a documented bound on what the driver sees: a row of statistics each).

Defined results: a null or empty text has all statistics 0 and gets a score like any other; a text of
any length is read whole; rows with equal ids are scored one by one; an empty table gives an empty table; without labels of both
kinds every score is the share of label 1 (a half without any label); extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
TREES, DEPTH, LEAF, LASSO = 40, 3, 20, 0.002

#: name -> expression over t (the text), w (its words), both never null
_WORDS = "size(w)"
_CHARS = "length(t)"


def _share(pattern: str, of: str = _CHARS) -> str:
    return f"(({_CHARS} - length(regexp_replace(t, '{pattern}', ''))) / greatest({of}, 1))"


STATISTICS = {
    "chars": "cast(length(t) as double)",
    "words": f"cast({_WORDS} as double)",
    "word_length": f"((length(t) - {_WORDS}) / greatest({_WORDS}, 1))",
    "lines": "cast(length(t) - length(replace(t, '\\n', '')) + 1 as double)",
    "distinct_words": f"(size(array_distinct(w)) / greatest({_WORDS}, 1))",
    "symbols": _share("[#*$%&|<>]"),
    "bars": "((length(t) - length(replace(t, '|', ''))) / greatest(length(t), 1))",
    "exclamations": "((length(t) - length(replace(t, '!', ''))) / greatest(length(t), 1))",
    "capitals": _share("[A-Z]"),
    "digits": _share("[0-9]"),
    "stops": _share("[.,;:?]"),
    "brackets": _share("[\\\\[\\\\]{}()=_/\\\\\\\\]"),
    "distinct_lines": "(size(array_distinct(split(t, '\\n'))) / greatest(size(split(t, '\\n')), 1))",
    "short_words": f"(size(filter(w, x -> length(x) < 4)) / greatest({_WORDS}, 1))",
    "long_words": f"(size(filter(w, x -> length(x) > 12)) / greatest({_WORDS}, 1))",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and a double column for each of STATISTICS."""
    t = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    w = t.withColumn("w", F.expr(r"filter(split(t, '[ \\t-\\r]+'), x -> x <> '')"))
    return w.select("id", *[F.expr(e).cast("double").alias(n) for n, e in STATISTICS.items()])


@dataclass(frozen=True)
class Rule:
    """A conjunction: every (statistic, threshold, above) holds."""

    terms: tuple[tuple[str, float, bool], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, cut, above in self.terms:
            out = out & ((F.col(name) > F.lit(cut)) if above else (F.col(name) <= F.lit(cut)))
        return out

    def values(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, cut, above in self.terms:
            v = x[:, names.index(name)]
            out &= (v > cut) if above else (v <= cut)
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1 over the statistics columns."""
        z = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z = z + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def best_split(x: np.ndarray, y: np.ndarray, columns) -> tuple[int, float] | None:
    """The threshold that lowers the squared error of y most."""
    best, found = 1e-9 + y.sum() ** 2 / len(y), None
    for c in columns:
        order = np.argsort(x[:, c], kind="stable")
        v, s = x[order, c], np.cumsum(y[order])
        n = np.arange(1, len(y))
        gain = s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(y) - n)
        gain[(v[1:] <= v[:-1]) | (n < LEAF) | (len(y) - n < LEAF)] = -np.inf
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > best + 1e-6:
            best, found = gain[k], (c, float((v[k] + v[k + 1]) / 2))
    return found


def tree_rules(x: np.ndarray, residual: np.ndarray, names: list[str], columns, depth: int, terms=()) -> tuple[list[Rule], np.ndarray]:
    """The rules of all nodes below the root, and the tree's fitted values."""
    split = best_split(x, residual, columns) if depth and len(x) >= 2 * LEAF else None
    if split is None:
        return [], np.full(len(x), residual.mean() if len(x) else 0.0)
    c, cut = split
    rules, fit = [], np.zeros(len(x))
    for above in (False, True):
        part = (x[:, c] > cut) == above
        path = (*terms, (names[c], cut, above))
        rules.append(Rule(path))
        more, fit[part] = tree_rules(x[part], residual[part], names, columns, depth - 1, path)
        rules += more
    return rules, fit


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights of the mean log loss plus penalty * sum |w|, by accelerated proximal steps. Rules are scaled to unit deviation meanwhile."""
    scale = np.maximum(r.std(axis=0), 0.02)
    x = (r - r.mean(axis=0)) / scale
    w = prev = np.zeros(x.shape[1])
    p = y.mean()
    b = prev_b = float(np.log(p / (1 - p)))
    v = np.ones(x.shape[1])
    for _ in range(20):  # the largest eigenvalue gives the step
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4.0 / (np.linalg.norm(x @ v) ** 2 / len(y) + 1.0)
    for k in range(steps):
        m = k / (k + 3)
        u, ub = w + m * (w - prev), b + m * (b - prev_b)
        e = 1 / (1 + np.exp(-(x @ u + ub))) - y
        prev, prev_b = w, b
        g = u - step * (x.T @ e) / len(y)
        w, b = np.sign(g) * np.maximum(np.abs(g) - step * penalty, 0), ub - step * e.mean()
    w = w / scale
    return float(b - w @ r.mean(axis=0)), w


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 13) -> Ensemble:
    """Trees on random halves of the rows and statistics, each fitted to what its predecessors leave; then the lasso over their rules."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Ensemble(float(np.log(p / (1 - p))))
    r = np.random.default_rng(seed)
    rules: dict[tuple, Rule] = {}
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        rows = r.permutation(len(y))[: max(2 * LEAF, len(y) // 2)]
        columns = r.permutation(len(names))[: max(3, len(names) // 2)]
        residual = y - 1 / (1 + np.exp(-z))
        found, _ = tree_rules(x[rows], residual[rows], names, columns, int(r.integers(1, DEPTH + 1)))
        leaves = [f for f in found if not any(g.terms[: len(f.terms)] == f.terms and g is not f for g in found)]
        for leaf in leaves:
            inside = leaf.values(x, names)
            z[inside] += 2.0 * residual[inside].mean() if inside.any() else 0
        for f in found:
            rules.setdefault(tuple(sorted(f.terms)), f)
    kept = list(rules.values())
    values = np.stack([f.values(x, names) for f in kept], axis=1).astype(float) if kept else np.zeros((len(y), 0))
    _, first = np.unique(values, axis=1, return_index=True)  # rules that hold for the same rows are one
    first = np.sort(first)
    b, w = lasso_logistic(values[:, first], y, LASSO)
    some = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(b, [kept[first[k]] for k in some], [float(w[k]) for k in some])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", allowed: Column | None = None, sample: int = SAMPLE) -> Ensemble:
    """An ensemble for ``label_col`` (0 or 1) from at most ``sample`` labelled rows for which ``allowed`` holds."""
    known = labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull() & (allowed if allowed is not None else F.lit(True)))
    known = known.select(labels[id_col].alias("k"), labels[label_col].cast("int").alias("y")).dropDuplicates(["k"])
    known = known.orderBy(F.xxhash64("k"), "k").limit(sample)
    few = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    texts = few.join(F.broadcast(known), few["id"] == known["k"]).select("id", "text", "y")  # at most `sample` ids and labels
    stats = statistics(texts, "id").withColumnRenamed("id", "sid")
    rows = stats.join(F.broadcast(known), stats["sid"] == known["k"]).drop("k").orderBy("sid", *STATISTICS).limit(2 * sample).toPandas()
    names = list(STATISTICS)
    return fit(rows[names].to_numpy(float), rows["y"].to_numpy(float), names)


def scored(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row of ``docs``."""
    return statistics(docs, id_col, text_col).select(F.col("id").alias(id_col), model.score().alias("score"))
