"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on labelled rows; every path to a node is a
conjunctive rule. A lasso-penalised logistic model weighs the rules, most
weights become zero, and the rest is compiled into one Spark column expression.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = ["bytes", "words", "word_bytes", "longest_word", "upper", "digits", "symbols", "stops", "bars", "high", "lines", "line_bytes", "distinct_words", "top_word", "distinct_lines", "distinct_pairs", "ending_symbols", "upper_words"]
#: Labelled rows that the rules are learned from, at most (a stable sample).
TRAINING_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 30, 3, 32, 0.3
#: Weight of the lasso penalty.
PENALTY = 1e-3

_CLASS = np.zeros(256, np.int64)
_CLASS[list(range(65, 91))] = 1  # upper case
_CLASS[list(range(48, 58))] = 2
_CLASS[list(b"#$%&*+/<=>@[\\]^_`{}~!")] = 3
_CLASS[list(b".,;:?")] = 4
_CLASS[ord("|")] = 5
_CLASS[list(range(128, 256))] = 6
_CLASS[10] = 7
_ENDINGS = tuple(b"#$%&*!|")


def statistics(text: bytes) -> list[float]:
    """The numbers of ``STATISTICS``; all zero for an empty text."""
    words = text.split()
    if not words:
        return [float(len(text))] + [0.0] * (len(STATISTICS) - 1)
    n, w = len(text), len(words)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    sizes = np.fromiter(map(len, words), np.int64, w)
    counts, lines = Counter(words), text.split(b"\n")
    pairs = len(set(zip(words, words[1:])))
    return [
        float(n), float(w), float(sizes.mean()), float(sizes.max()), kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / w, kinds[5] / w, kinds[6] / n,
        float(len(lines)), n / len(lines), len(counts) / w, max(counts.values()) / w, len(set(lines)) / len(lines), pairs / max(1, w - 1),
        sum(x[-1] in _ENDINGS for x in words) / w, sum(map(bytes.isupper, words)) / w,
    ]


def _statistics_batch(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t.encode() if t else b"") for t in texts])


def statistics_of(text: str) -> Column:
    """Array of the statistics of a text column."""
    return F.pandas_udf(_statistics_batch, "array<double>")(F.col(text))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold) of each condition


def grow(binned: np.ndarray, edges: list[np.ndarray], y: np.ndarray) -> set[Rule]:
    """Rules of all nodes of boosted trees."""
    rules: set[Rule] = set()
    margin = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        for depth in range(DEPTH):
            after = []
            for rows, path in nodes:
                best = (1e-9, None, None)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f in range(binned.shape[1]):
                    gs = np.cumsum(np.bincount(binned[rows, f], g[rows], BINS))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, f], h[rows], BINS))[:-1]
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                    gain[(hs < 1) | (total_h - hs < 1)] = 0
                    k = int(gain.argmax()) if len(gain) else 0
                    if k < len(edges[f]) and gain[k] > best[0]:
                        best = (gain[k], f, k)
                _, f, k = best
                if f is None:
                    margin[rows] += RATE * total_g / (total_h + 1)
                    continue
                left = binned[rows, f] <= k
                for part, above in ((rows[left], False), (rows[~left], True)):
                    after.append((part, path + ((f, above, float(edges[f][k])),)))
                    rules.add(after[-1][1])
            nodes = after
        for rows, _ in nodes:
            margin[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)
    return rules


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) if above else (x[:, f] <= t)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient on standardised rules."""
    mean, scale = r.mean(0), np.maximum(r.std(0), 1e-3)
    z = (r - mean) / scale
    n = len(y)
    lipschitz = 0.25 * (np.linalg.norm(z, 2) ** 2 / n + 1)
    w, b = np.zeros(z.shape[1]), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    wv, bv, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(z @ wv + bv))) - y
        w2 = wv - z.T @ e / n / lipschitz
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - PENALTY / lipschitz, 0)
        b2 = bv - e.mean() / lipschitz
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        wv, bv = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w / scale, b - float((w * mean / scale).sum())


class Ensemble:
    """Weighted rules; :meth:`score` is their Spark expression."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float) -> None:
        self.rules, self.weights, self.intercept = rules, weights, intercept

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Ensemble:
        if not len(y) or y.min() == y.max():
            return cls([], [], 0.0 if not len(y) else (20.0 if y[0] else -20.0))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        rules = sorted(grow(binned, edges, y))
        if not rules:
            return cls([], [], math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        w, b = lasso_logistic(np.stack([holds(r, x) for r in rules], axis=1).astype(float), y)
        kept = [i for i in range(len(rules)) if abs(w[i]) > 1e-6]
        return cls([rules[i] for i in kept], [float(w[i]) for i in kept], float(b))

    def score(self, stats: Column) -> Column:
        """Probability of label 1 as an expression over the array of statistics."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            test = F.lit(True)
            for f, above, t in rule:
                test = test & ((stats[f] > t) if above else (stats[f] <= t))
            total = total + F.when(test, w).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Ensemble:
    """Fit on at most ``rows`` labelled documents of ``docs(doc_id, text)`` and ``labels(doc_id, label)``.

    The labels are chosen by a hash of the id; of those not marked alike the
    greater counts, and of documents with one id each. Only the chosen, which
    are few enough to broadcast, get statistics here.
    """
    marked = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "label"), "doc_id")
    sample = texts.select("doc_id", "label", statistics_of("text").alias("stats")).orderBy("doc_id", "stats").limit(2 * rows).toArrow()
    x = np.array(sample.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, len(STATISTICS))
    return Ensemble.fit(x, sample.column(1).to_numpy().astype(float))


def quality(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """Score ``docs(doc_id, text)``: ``doc_id, held_out, score, predicted``.

    ``labels(doc_id, label)`` are learned from only where ``held_out`` (an
    expression over doc_id) is false. A null or empty text has zero statistics
    and is scored like any other; without labels, or with one kind only, the
    score is constant; repeated rows and null ids are kept; extra columns are
    ignored; an empty table gives no rows.
    """
    model = learn(docs, labels.where(~held_out))
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics_of("text").alias("stats"))
    return stats.select("doc_id", held_out.alias("held_out"), model.score(F.col("stats")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
