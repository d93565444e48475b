"""Quality rules as a learned decision list.

Sequential covering: a rule is a conjunction of thresholds on text statistics, grown on two thirds of the labelled sample by FOIL gain
and pruned on the rest; it is kept if it is precise, the documents it covers leave the sample, and the next rule is grown. Documents count by the number of labelled ones that they stand for,
so precision is that of the labelled corpus, whatever the sample's mixture.
The ordered rules become one Spark conditional expression.

Nulls: a null text is empty, and an empty text fails the base test. Without labels there are no rules and the base test decides alone.
Repeated rows get equal verdicts; a document on a threshold has a defined side of it; texts of any length are counted whole; extra columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table
from .textstats import COUNTS, LIST_FEATURES, condition, sample, with_stats

#: The fit reads at most this many labelled documents.
SAMPLE = 4000
MOST_RULES, MOST_CONDITIONS, LEAST_PRECISION, LEAST_COVER, CUTS = 12, 3, 0.99, 3, 32


@dataclass(frozen=True)
class Rule:
    conditions: tuple[tuple[str, str, float], ...]

    def matches(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        hit = np.ones(len(x), dtype=bool)
        for name, sign, cut in self.conditions:
            v = x[:, names.index(name)]
            hit &= (v <= cut) if sign == "<=" else (v > cut)
        return hit

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, cut in self.conditions:
            out = out & condition(name, sign, cut)
        return out


@dataclass
class DecisionList:
    """Documents that a rule matches are rejected by the first such rule; the others are kept."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        return self._chain(lambda i: F.lit(False), F.lit(True))

    def fired(self) -> Column:
        """The number of the first rule that matches, from 1; else null."""
        return self._chain(lambda i: F.lit(i), F.lit(None).cast("int"))

    def _chain(self, then, otherwise: Column) -> Column:
        if not self.rules:
            return otherwise
        out = F.when(self.rules[0].column(), then(1))
        for i, rule in enumerate(self.rules[1:], 2):
            out = out.when(rule.column(), then(i))
        return out.otherwise(otherwise)


def _cuts(v: np.ndarray) -> np.ndarray:
    """Candidate thresholds: midpoints between neighbouring distinct values near the quantiles."""
    u = np.unique(v)
    if len(u) < 2:
        return u[:0]
    mids = (u[1:] + u[:-1]) / 2
    return mids if len(mids) <= CUTS else np.unique(mids[np.linspace(0, len(mids) - 1, CUTS).astype(int)])


def _grow(x: np.ndarray, bad: np.ndarray, w: np.ndarray, names: tuple[str, ...]) -> list[tuple[str, str, float]]:
    hit, out = np.ones(len(x), dtype=bool), []
    while len(out) < MOST_CONDITIONS and (hit & ~bad).any():
        p0, n0 = w[hit & bad].sum(), w[hit & ~bad].sum()
        best = (1e-9, None)
        for j, name in enumerate(names):
            for cut in _cuts(x[hit, j]):
                for sign in ("<=", ">"):
                    new = hit & ((x[:, j] <= cut) if sign == "<=" else (x[:, j] > cut))
                    p, n = w[new & bad].sum(), w[new & ~bad].sum()
                    if p:
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, (name, sign, float(cut)), new)
        if best[1] is None:
            break
        out.append(best[1])
        hit = best[2]
    return out


def learn(features: list[list[float]], labels: list[int], names: tuple[str, ...] = LIST_FEATURES, weights: list[float] | None = None) -> DecisionList:
    """labels: 1 good, 0 to be rejected. weights: how many documents each stands for (one if not given)."""
    x = np.array(features, dtype=float).reshape(-1, len(names))
    bad = np.array(labels, dtype=int) == 0
    w = np.ones(len(x)) if weights is None else np.array(weights, dtype=float)
    prune = np.arange(len(x)) % 3 == 2
    alive, rules = np.ones(len(x), dtype=bool), []
    while len(rules) < MOST_RULES and (alive & bad & ~prune).sum() >= LEAST_COVER:
        grow = alive & ~prune
        conditions = _grow(x[grow], bad[grow], w[grow], names)
        if not conditions:
            break
        best = (-2.0, None)
        for k in range(len(conditions), 0, -1):
            rule = Rule(tuple(conditions[:k]))
            hit = rule.matches(x, names) & alive & prune
            p, n = w[hit & bad].sum(), w[hit & ~bad].sum()
            worth = (p - n) / (p + n) if p + n else -1.0
            if worth > best[0]:
                best = (worth, rule)
        rule = best[1]
        hit = rule.matches(x, names) & alive
        p, n = w[hit & bad].sum(), w[hit & ~bad].sum()
        if (hit & bad).sum() < LEAST_COVER or p / (p + n) < LEAST_PRECISION:
            break
        rules.append(rule)
        alive &= ~hit
    return DecisionList(rules)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DecisionList:
    x, y, w = sample(labels, documents(docs), "quality", LIST_FEATURES, most, held_out=False)
    return learn(x, y, LIST_FEATURES, w)


def judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """All columns but the text, the counts, base_failed, kept and the number of the rule that rejected."""
    d = with_stats(docs).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(rules.verdict())
    return d.withColumn("kept", kept).withColumn("rule", F.when(~F.col("base_failed"), rules.fired()).cast("int"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    rules = fit(spark, docs, table(spark, sf_dir, "labels"))
    return judged(docs, rules).select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def filter_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    rules = fit(spark, docs, labels)
    names = docs.columns
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("text").cast("string").alias("text"))
    return judged(row, rules).filter("kept").select("_row.*")
