"""Quality classifier: a sparse ensemble of rules (operator 1).

Boosted trees are grown over text statistics; every path from a root becomes a conjunctive rule;
a lasso logistic regression keeps the few rules that matter; and these are compiled into one
Spark column over the statistics.  Scoring runs in the JVM, on every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language import held_out

#: Labelled rows that a model is fitted on at most: those of smallest hash of doc_id.
SAMPLE = 20_000
#: Characters kept by a pattern that deletes all others; their share of the text is a statistic.
_KEPT = {
    "upper": r"[^\p{Lu}]+",
    "letters": r"[^\p{L}]+",
    "digits": r"[^0-9]+",
    "spaces": r"[^\s]+",
    "symbols": r"[^#$%&*@^~<>{}\[\]\\_=+/]+",
    "pipes": r"[^|]+",
    "exclaims": r"[^!?]+",
    "stops": r"[^.,;:]+",
    "lines": r"[^\n]+",
}
STATISTICS = ("log_chars", *_KEPT, "word_length", "distinct_words", "distinct_lines")


def statistics(text: Column) -> list[Column]:
    """The statistics of a text; a null text counts as empty, and all of an empty text's are 0."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    words, lines = F.split(text, r"\s+"), F.split(text, "\n")
    shares = [F.char_length(F.regexp_replace(text, pattern, "")) / n for pattern in _KEPT.values()]
    return [
        c.cast("double").alias(name)
        for name, c in zip(
            STATISTICS,
            [
                F.log1p(F.char_length(text).cast("double")),
                *shares,
                F.char_length(text) / F.size(words),
                F.when(F.char_length(text) == 0, 0.0).otherwise(F.size(F.array_distinct(words)) / F.size(words)),
                F.when(F.char_length(text) == 0, 0.0).otherwise(F.size(F.array_distinct(lines)) / F.size(lines)),
            ],
        )
    ]


@dataclass(frozen=True)
class Condition:
    """``statistic <= bound`` or, with above, ``statistic > bound``."""

    statistic: int
    bound: float
    above: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.statistic] > self.bound) == self.above

    def column(self, of: str = "") -> Column:
        c = F.col(of + STATISTICS[self.statistic])
        return c > self.bound if self.above else c <= self.bound


Rule = tuple[Condition, ...]


def _grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: Rule, out: list, step: np.ndarray) -> None:
    """A regression tree on the gradient; appends the path of every node, sets ``step`` at the leaves."""
    g, h, best = gradient[rows].sum(), hessian[rows].sum(), None
    if depth and len(rows) >= 40:
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = np.searchsorted(c, x[rows, j], "left")
            gl = np.cumsum(np.bincount(b, gradient[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hessian[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < 20) | (len(rows) - nl < 20)] = -1
            k = int(gain.argmax())
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = gain[k], j, float(c[k])
    if best is None:
        step[rows] = g / (h + 1)
        return
    _, j, bound = best
    for above in (False, True):
        grown = (*path, Condition(j, bound, above))
        out.append(grown)
        _grow(x, cuts, gradient, hessian, rows[Condition(j, bound, above).holds(x[rows])], depth - 1, grown, out, step)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2) -> list[Rule]:
    """The distinct paths of boosted trees; each tree sees a random half of the rows."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64)))[:-1] for j in range(x.shape[1])]
    score, rules, random = np.zeros(len(y)), [], np.random.default_rng(5)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        rows = np.flatnonzero(random.random(len(y)) < 0.5)
        found: list[Rule] = []
        _grow(x, cuts, y - p, p * (1 - p), rows, depth, (), found, step)
        score += rate * step
        rules += found
    return list(dict.fromkeys(rules))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n, (w, b) = len(y), (np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
    v, c, t = w.copy(), b, 1.0
    step = 4 / max(1e-9, (np.linalg.norm(z, 2) ** 2 / n + 1))
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        w2 = v - step * (z.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2, t2 = c - step * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self, of: str = "") -> Column:
        """The score, over columns named by STATISTICS, with ``of`` before each name."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(reduce(lambda a, b: a & b, [c.column(of) for c in rule]), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = 1e-3) -> Ensemble:
    """Fit on at most ``sample`` labelled rows that are not held out; a doc_id's label is the mean of its labels."""
    rows = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    few = rows.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # ``few`` has at most ``sample`` rows of two numbers; of texts that share a doc_id one is learned from
    measured = docs.join(F.broadcast(few), F.col("doc_id") == F.col("label_id")).select("label_id", *statistics(F.col("text")), "y")
    one = measured.groupBy("label_id").agg(F.max(F.struct(*STATISTICS, "y")).alias("row")).select("row.*")
    known = one.toPandas().to_numpy(float)
    if not len(known):
        return Ensemble([], [], 0.0)
    known = known[np.lexsort(known.T)]  # the same model whatever the order of the rows
    x, y = known[:, :-1], known[:, -1]
    if y.min() == y.max():
        return Ensemble([], [], 4.0 if y[0] else -4.0)
    rules = tree_rules(x, y)
    if not rules:  # too few rows to split: the share of the labels alone
        return Ensemble([], [], float(np.log(y.mean() / (1 - y.mean()))))
    z = np.stack([reduce(np.logical_and, [c.holds(x) for c in r]) for r in rules], axis=1).astype(float)
    w, b = lasso_logistic(z, y, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-3)
    return Ensemble([rules[i] for i in keep], [float(w[i]) for i in keep], float(b))


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents(doc_id, text)``.

    labels(doc_id, quality).  Learns only from labels whose doc_id is not held out (crc32 of the
    doc_id as text leaves a remainder modulo 5); a score depends on the text alone.  Null and
    empty texts are scored as texts without characters; null doc_ids are not held out; repeated
    rows all come back; null labels are left out.  Without labels every score is 0.5, with labels
    of one kind it is that kind's, and with too few to grow a tree their share.  Rows of
    ``documents`` that share a labelled doc_id are learned from as one, that of the greatest statistics.
    Other columns are ignored.
    """
    model = fit(documents, labels, sample)
    measured = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), *statistics(F.col("text")))
    scored = measured.select("doc_id", "held_out", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose score reaches the threshold; rows as in ``score_quality``."""
    model = fit(documents, labels, sample)
    # behind a generator of one row the statistics are made once; a filter on plain columns would repeat them in every rule
    measured = documents.select("*", F.inline(F.array(F.struct(*[c.alias(f"__{name}") for c, name in zip(statistics(F.col("text")), STATISTICS)]))))
    return measured.where(model.column("__") >= threshold).select(*documents.columns)
