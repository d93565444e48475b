"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow regression trees are boosted on weighted random subsamples; every path from a root to a node is a conjunctive rule. A lasso logistic regression
(proximal gradient, with the penalty chosen on a held-back part of the training rows) weighs the rules and drops most of them. What remains
is compiled into one Spark column expression, so scoring needs no Python. Rows count by the number of labelled ones that they stand for, so scores hold for the labelled corpus, whatever the sample's mixture.

A null text scores as an empty one. Without labelled rows, or with one class only, the score is the base rate (1 if there is none). Repeated rows and documents with equal statistics get equal
scores; a document on a threshold has a defined side of it; texts of any length are counted whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table
from .textstats import SCORE_FEATURES, condition, sample, with_stats

#: The fit reads at most this many labelled documents.
SAMPLE = 4000
TREES, DEPTH, LEAF, RATE, SEED = 24, 3, 5, 0.3, 5
Condition = tuple[int, str, float]


@dataclass
class RuleEnsemble:
    names: tuple[str, ...]
    rules: list[tuple[Condition, ...]]
    weights: list[float]
    intercept: float

    def logit(self) -> Column:
        out = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            hit = F.lit(True)
            for j, sign, cut in rule:
                hit = hit & condition(self.names[j], sign, cut)
            out = out + F.when(hit, F.lit(float(weight))).otherwise(0.0)
        return out

    def score(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.logit()))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z += weight * covers(rule, x)
        return 1 / (1 + np.exp(-z))


def covers(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for j, sign, cut in rule:
        hit &= (x[:, j] <= cut) if sign == "<=" else (x[:, j] > cut)
    return hit


def _split(x: np.ndarray, r: np.ndarray) -> tuple[float, int, float] | None:
    """The split that lowers the squared error of r most."""
    best = None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, s = x[order, j], np.cumsum(r[order])
        n = np.arange(1, len(v))
        ok = (v[1:] > v[:-1]) & (n >= LEAF) & (len(v) - n >= LEAF)
        if ok.any():
            gain = np.where(ok, s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(v) - n) - s[-1] ** 2 / len(v), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), j, float((v[k] + v[k + 1]) / 2))
    return best


def _tree(x: np.ndarray, r: np.ndarray, path: tuple[Condition, ...], paths: list, leaves: list) -> None:
    found = _split(x, r) if len(path) < DEPTH and len(x) >= 2 * LEAF else None
    if found is None:
        leaves.append((path, float(r.mean())))
        return
    _, j, cut = found
    left = x[:, j] <= cut
    for sign, side in (("<=", left), (">", ~left)):
        paths.append((*path, (j, sign, cut)))
        _tree(x[side], r[side], (*path, (j, sign, cut)), paths, leaves)


def extract(x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int = SEED) -> list[tuple[Condition, ...]]:
    """Distinct rules of boosted trees; of rules that cover the same rows, the shortest."""
    rng, z, rules = np.random.default_rng(seed), np.zeros(len(y)), []
    for _ in range(TREES):
        r = y - 1 / (1 + np.exp(-z))
        rows = rng.random(len(y)) < 0.5 * w / w.max()
        if rows.sum() < 2 * LEAF:
            rows[:] = True
        leaves: list = []
        _tree(x[rows], r[rows], (), rules, leaves)
        for path, value in leaves:
            z += RATE * 4 * value * covers(path, x)
    seen: dict[bytes, tuple[Condition, ...]] = {}
    for rule in sorted(rules, key=len):
        hit = covers(rule, x)
        if hit.any() and not hit.all():
            seen.setdefault(np.packbits(hit).tobytes(), rule)
    return list(seen.values())


def lasso(h: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated proximal gradient."""
    n, k = h.shape
    beta, bias, look, look_b, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    total = w.sum()
    v = np.ones(k + 1)
    full = np.hstack([h, np.ones((n, 1))])
    for _ in range(20):  # the largest eigenvalue, by powers
        v = full.T @ (w[:, None] * (full @ v[:, None]))[:, 0]
        v /= np.linalg.norm(v) or 1.0
    lip = 0.25 * float(v @ (full.T @ (w * (full @ v)))) / total + 1e-9
    for _ in range(steps):
        g = w * (1 / (1 + np.exp(-np.clip(h @ look + look_b, -40, 40))) - y) / total
        new = look - h.T @ g / lip
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / lip, 0)
        new_b = look_b - g.sum() / lip
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, look_b = new + (t - 1) / t2 * (new - beta), new_b + (t - 1) / t2 * (new_b - bias)
        beta, bias, t = new, new_b, t2
    return beta, bias


def learn(features: list[list[float]], labels: list[int], names: tuple[str, ...] = SCORE_FEATURES, weights: list[float] | None = None) -> RuleEnsemble:
    x, y = np.array(features, dtype=float).reshape(-1, len(names)), np.array(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble(names, [], [], 20.0 if len(y) == 0 or y[0] == 1 else -20.0)
    w = np.ones(len(y)) if weights is None else np.array(weights, dtype=float)
    w /= w.mean()
    rules = extract(x, y, w)
    if not rules:
        base = float((w * y).sum() / w.sum())
        return RuleEnsemble(names, [], [], float(np.log(base / (1 - base))))
    h = np.stack([covers(r, x) for r in rules], axis=1).astype(float)
    back = np.arange(len(y)) % 5 == 4
    best = (np.inf, 0.01)
    for penalty in (0.03, 0.01, 0.003, 0.001):
        beta, bias = lasso(h[~back], y[~back], w[~back], penalty)
        p = np.clip(1 / (1 + np.exp(-np.clip(h[back] @ beta + bias, -40, 40))), 1e-6, 1 - 1e-6)
        loss = -float(np.average(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p), weights=w[back])) if back.any() else 0.0
        if loss < best[0] - 1e-3:
            best = (loss, penalty)
    beta, bias = lasso(h, y, w, best[1])
    used = np.flatnonzero(np.abs(beta) > 1e-6)
    return RuleEnsemble(names, [rules[i] for i in used], [float(beta[i]) for i in used], float(bias))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> RuleEnsemble:
    x, y, w = sample(labels, documents(docs), "quality", SCORE_FEATURES, most, held_out=True)
    return learn(x, y, SCORE_FEATURES, w)


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    d = with_stats(documents(docs), more=True)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    d = d.select("doc_id", held.alias("held_out"), model.score().alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
