"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Shallow trees are grown on bootstrap draws of a bounded sample of labelled documents; every path from
a root to a node below it is a conjunctive rule over text statistics. A lasso logistic regression
(accelerated proximal gradient) weighs the rules, and those left with a weight become one column
expression. The sample holds at most ``SAMPLE_PER_LABEL`` rows of each label, weighted back to the
labels' shares among all rows that may be learned from.

Defined results: null text counts as empty, and empty texts are scored by their (zero) statistics;
without any labelled row every score is 0.5, and an input without rows gives none. Rows of the held-out fold are not learned from, nor rows
whose label is null. Repeated texts get equal scores; a null doc_id is carried through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.llm.folds import bounded_sample, held_out
from haulframe.llm.storage import free_name
from haulframe.llm.text_statistics import NAMES, with_statistics

SAMPLE_PER_LABEL = 3000
TREES = 40
DEPTH = 3
LEAST_IN_LEAF = 10
PENALTY = 1e-3
STEPS = 400
THRESHOLD = 0.7

#: One comparison: statistic, whether it must be above, and the bound.
Test = tuple[int, bool, float]


@dataclass
class Rules:
    rules: list[tuple[Test, ...]]
    weights: list[float]
    bias: float


def _best_split(x: np.ndarray, y: np.ndarray, w: np.ndarray, features: np.ndarray) -> tuple[int, float] | None:
    """The split with the least weighted Gini impurity."""
    best, found = np.inf, None
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, ws, ys = x[order, f], np.cumsum(w[order]), np.cumsum((w * y)[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= LEAST_IN_LEAF) & (len(v) - at - 1 >= LEAST_IN_LEAF)]
        if len(at):
            left, right = ws[at], ws[-1] - ws[at]
            impurity = ys[at] * (1 - ys[at] / left) + (ys[-1] - ys[at]) * (1 - (ys[-1] - ys[at]) / right)
            i = int(impurity.argmin())
            if impurity[i] < best - 1e-12:
                best, found = impurity[i], (int(f), float((v[at[i]] + v[at[i] + 1]) / 2))
    return found


def _paths(x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, path: tuple[Test, ...] = ()) -> list[tuple[Test, ...]]:
    """The rules of all nodes below the root of one tree."""
    if len(path) == DEPTH or len(np.unique(y)) < 2:
        return []
    split = _best_split(x, y, w, rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False))
    if split is None:
        return []
    out = []
    for above in (False, True):
        side = (x[:, split[0]] > split[1]) == above
        rule = (*path, (split[0], above, split[1]))
        out += [rule, *_paths(x[side], y[side], w[side], rng, rule)]
    return out


def _holds(rule: tuple[Test, ...], x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] > bound) == above for f, above, bound in rule])


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int = 3) -> Rules | None:
    """Rules and weights from statistics, labels 0 or 1 and row weights; None without rows."""
    if not len(y):
        return None
    w = w / w.sum()
    rate = float(np.clip((w * y).sum(), 1e-3, 1 - 1e-3))
    rng = np.random.default_rng(seed)
    seen: dict[bytes, tuple[Test, ...]] = {}
    for _ in range(TREES):
        draw = rng.choice(len(y), len(y), p=w)
        for rule in _paths(x[draw], y[draw].astype(float), np.ones(len(draw)), rng):
            holds = _holds(rule, x)
            if 0 < holds.sum() < len(y):  # of rules that hold for the same rows, the shortest
                key = np.packbits(holds).tobytes()
                if key not in seen or len(rule) < len(seen[key]):
                    seen[key] = rule
    rules = list(seen.values())
    bias = np.log(rate / (1 - rate))
    if not rules:
        return Rules([], [], float(bias))
    a = np.stack([_holds(r, x) for r in rules], 1).astype(np.float64)
    spread = np.sqrt(np.maximum((w[:, None] * (a - w @ a) ** 2).sum(0), 1e-6))
    a = (a - w @ a) / spread
    step = 4 / max(np.linalg.norm(a * np.sqrt(w)[:, None], 2) ** 2, 1e-9)
    weights = np.zeros(len(rules))
    ahead, t, at_bias = weights.copy(), 1.0, bias
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(a @ ahead + at_bias)))
        error = w * (p - y)
        new = ahead - step * (a.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        at_bias -= error.sum() * 2
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, weights, t = new + (t - 1) / t_new * (new - weights), new, t_new
    plain = weights / spread
    centre = w @ np.stack([_holds(r, x) for r in rules], 1).astype(np.float64)
    kept = np.flatnonzero(np.abs(weights) > 1e-9)
    return Rules([rules[i] for i in kept], [float(plain[i]) for i in kept], float(at_bias - centre @ plain))


def expression(model: Rules | None, names: dict[str, str]) -> Column:
    """The score as a column over the statistics; names gives the column of each statistic."""
    if model is None:
        return F.lit(0.5)
    total = F.lit(model.bias)
    for rule, weight in zip(model.rules, model.weights):
        tests = [F.col(names[NAMES[f]]) > bound if above else F.col(names[NAMES[f]]) <= bound for f, above, bound in rule]
        total = total + F.when(reduce(lambda a, b: a & b, tests), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> Rules | None:
    """Rules learned from a bounded sample of the labelled documents outside the held-out fold."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).cast("bigint").alias("i"), F.col(label).cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    rows = bounded_sample(known, "y", "i", per_label)
    if not rows:
        return None
    # at most 2 * per_label rows; a document may stand there any number of times, and counts once
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(r["i"], r["y"]) for r in rows], "i bigint, y int"))
    found = docs.select(F.col(doc_id).cast("bigint").alias("i"), F.col(text).alias("t")).join(chosen, "i")
    measured = with_statistics(found, "t", {n: n for n in NAMES})
    one = measured.groupBy("i").agg(F.min(F.struct(*(c for c in measured.columns if c != "i"))).alias("r")).select("i", "r.*")
    got = sorted(tuple(r) for r in one.collect())
    if not got:
        return None
    x, y = np.array([r[2:] for r in got], np.float64), np.array([r[1] for r in got])
    share = {k: totals[k] / max(1, (y == k).sum()) for k in totals}
    return fit(x, y, np.array([share[k] for k in y.tolist()], np.float64))


def score(docs: DataFrame, model: Rules | None, text: str = "text") -> DataFrame:
    """docs without its text, with score and predicted (the names are lengthened if docs has them)."""
    names: dict[str, str] = {}
    for n in NAMES:
        names[n] = free_name(f"stat_{n}", [*docs.columns, *names.values()])
    measured = with_statistics(docs, text, names)
    out, predicted = free_name("score", docs.columns), free_name("predicted", docs.columns)
    return measured.withColumn(out, expression(model, names)).withColumn(predicted, (F.col(out) >= THRESHOLD).cast("int")).drop(*names.values())


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
