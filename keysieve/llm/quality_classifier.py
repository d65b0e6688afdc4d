"""Quality scores: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

Calibration is learned out of fold: each row's raw score comes from weights that were fitted without its fold, so the
levels tell how good the ranking is on rows not learned from. Rows of equal statistics share a fold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import landed, split_words
from keysieve.llm.quality_rules import SYMBOLS, repeated_words

PUNCTUATION = ".,;:?'\"()-"


def statistics(text: str | None) -> list[float]:
    """What the classifier knows of a text: lengths, repetition, character classes, line shapes."""
    text = text or ""
    words = split_words(text)
    n, chars = max(len(words), 1), max(len(text), 1)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lines = [line for line in text.split("\n") if line.strip()]
    letters = sum(map(str.isalpha, words))
    return [
        np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), len(counts) / n ** 0.75,
        top / n, sum(a == b for a, b in zip(words, words[1:])) / n, repeated_words(words) / n,
        sum(map(text.count, SYMBOLS)) / n, text.count("!") / n, text.count("|") / n,
        sum(map(str.isupper, words)) / n, sum(map(str.islower, words)) / n, letters / n,
        sum(map(text.count, "0123456789")) / chars, sum(map(text.count, PUNCTUATION)) / chars,
        text.count(".") / n, len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)), np.log1p(len(text) / max(len(lines), 1)),
        float(not words),
    ]


def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts], dtype=object)


@dataclass
class Classifier:
    """``features`` cosines of random projections; the kernel's width is in units of the statistics' deviations."""

    features: int = 160
    width: float = 4.0
    ridge: float = 1e-3
    bins: int = 1000
    folds: int = 5
    seed: int = 7
    mean: np.ndarray = field(default=None, repr=False)
    scale: np.ndarray = field(default=None, repr=False)
    weights: np.ndarray = field(default=None, repr=False)
    knots: np.ndarray = field(default=None, repr=False)
    levels: np.ndarray = field(default=None, repr=False)

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """The feature map, with a constant in the last column."""
        rng = np.random.default_rng(self.seed)
        w = rng.normal(size=(x.shape[1], self.features)) / self.width
        b = rng.uniform(0, 2 * np.pi, self.features)
        z = np.clip((x - self.mean) / self.scale, -20, 20)
        cosines = np.sqrt(2 / self.features) * np.cos(z @ w + b)
        return np.hstack([cosines, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence next to ``value`` in weighted least squares (adjacent violators pooled)."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in pools])


def centred(at: np.ndarray, ones: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the calibration: every pool of the isotonic fit stands at its mean raw score.

    Scores between two pools rise from one to the other, so rows keep their ranks where a step would tie them. A pool's
    share counts half a row of each label more, and what lies beyond the outermost pools rises to 0 and 1.
    """
    pool = np.unique(isotonic(ones / count, count), return_inverse=True)[1]
    n = np.bincount(pool, count)
    knots = np.bincount(pool, at * count) / n
    levels = np.maximum.accumulate((np.bincount(pool, ones) + 0.5) / (n + 1))
    return np.concatenate([[-0.5], knots, [1.5]]), np.concatenate([[0.0], levels, [1.0]])


def fit(labelled: DataFrame, model: Classifier | None = None) -> Classifier:
    """Fit on all rows of (stats, label). Only sums of fixed size reach the driver.

    Without rows, or with one class alone, every score is that class' share (0.5 without rows).
    """
    model = model or Classifier()
    width = len(statistics(""))
    moments = labelled.agg(F.count("*").alias("n"), F.avg("label").alias("share"),
                           *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(width)],
                           *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(width)]).first()
    if not moments["n"] or moments["share"] in (0.0, 1.0):
        model.mean, model.scale = np.zeros(width), np.ones(width)
        model.weights = np.zeros(model.features + 1)
        model.knots, model.levels = np.array([0.0]), np.array([moments["share"] if moments["n"] else 0.5])
        return model
    model.mean = np.array([moments[f"m{i}"] for i in range(width)])
    model.scale = np.maximum(np.array([moments[f"s{i}"] for i in range(width)]), 1e-6)
    size = model.features + 1

    folded = labelled.select("stats", "label", F.pmod(F.xxhash64("stats"), F.lit(model.folds)).cast("int").alias("fold"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((model.folds, size, size + 1))
        for batch in batches:
            for fold, rows in batch.groupby("fold"):
                z = model.fourier(np.stack(rows["stats"]))
                total[fold, :, :size] += z.T @ z
                total[fold, :, size] += z.T @ rows["label"].to_numpy(float)
        for fold in range(model.folds):
            yield pd.DataFrame({"fold": fold, "i": np.arange(size), "v": list(total[fold])})

    rows = (folded.mapInPandas(products, "fold int, i int, v array<double>")
            .groupBy("fold", "i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect())
    total = np.zeros((model.folds, size, size + 1))
    for r in rows:
        total[r["fold"], r["i"]] = r["v"].toArray()

    def solved(sums: np.ndarray) -> np.ndarray:
        # The last feature is constant 1, so its product with itself is the number of rows.
        penalty = model.ridge * sums[-1, size - 1] * np.eye(size) / size + 1e-9 * np.eye(size)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(sums[:, :size] + penalty, sums[:, size])

    model.weights = solved(total.sum(axis=0))
    without = np.stack([solved(total.sum(axis=0) - own) for own in total])

    @F.pandas_udf("double")
    def raw(stats: pd.Series, fold: pd.Series) -> pd.Series:
        if not len(stats):
            return pd.Series([], dtype=float)
        return pd.Series(np.einsum("ij,ij->i", model.fourier(np.stack(stats)), without[fold.to_numpy()]))

    # Raw scores are near 0 or 1; what lies beyond -0.5 and 1.5 shares the outermost bins.
    at = F.floor((F.least(F.greatest(raw("stats", "fold"), F.lit(-0.5)), F.lit(1.5)) + 0.5) / 2 * (model.bins - 1))
    table = (folded.select(at.cast("int").alias("bin"), "label").groupBy("bin")
             .agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("bin").collect())
    count = np.array([r["n"] for r in table], dtype=float)
    at = (np.array([r["bin"] for r in table]) + 0.5) / (model.bins - 1) * 2 - 0.5
    model.knots, model.levels = centred(at, np.array([float(r["ones"]) for r in table]), count)
    return model


def classify(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text",
             label: str = "quality", threshold: float = 0.3, model: Classifier | None = None) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``, learned from the labelled rows where ``learn`` holds.

    A null text is an empty one; both get a score. A null label isn't learned from. A document labelled more than once
    is learned from with its mean label. Repeated rows are scored each. ``learn`` may use the column ``doc_id`` only.
    """
    stats = landed(docs.select(F.col(doc_id).alias("doc_id"), F.pandas_udf(_statistics, "array<double>")(text).alias("stats")), "stats")
    known = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label"))
             .dropna().groupBy("doc_id").agg(F.avg("label").alias("label")))
    fitted = fit(landed(stats.filter(learn).join(known, "doc_id").select("stats", "label"), "labelled"), model)

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(fitted.score(np.stack(stats)) if len(stats) else [], dtype=float)

    return (stats.select("doc_id", score("stats").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
