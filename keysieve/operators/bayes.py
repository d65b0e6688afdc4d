"""A text classifier and a snippet encoder whose every number can be checked: naive Bayes from counts, signed feature hashing."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.functions.text import normalise_quotes
from keysieve.operators.models import Encoder, Model
from keysieve.operators.skew import lookup_join

# A word is a run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


class NaiveBayes(NamedTuple):
    """``weights`` (word, weight) has the log odds a known word adds for a leak, ``prior`` those of no word."""

    weights: DataFrame
    prior: float


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def fit_naive_bayes(rows: DataFrame, is_leak: Column, text: str = "snippet") -> NaiveBayes:
    """Multinomial naive Bayes with one added to every count; each row has a text and is a leak or not (null: left out).

    The counts are partial aggregates; only the totals of both classes reach the driver.
    """
    labelled = rows.select(is_leak.cast("int").alias("leak"), words(F.col(text)).alias("words")).filter("leak is not null")
    docs = labelled.agg(F.coalesce(F.sum("leak"), F.lit(0)).alias("leaks"), F.count("*").alias("n")).first()
    counts = (labelled.select("leak", F.explode("words").alias("word")).groupBy("word")
              .agg(F.sum("leak").alias("leaks"), F.sum(1 - F.col("leak")).alias("others")))
    total = counts.agg(F.count("*").alias("words"), F.coalesce(F.sum("leaks"), F.lit(0)).alias("leaks"),
                       F.coalesce(F.sum("others"), F.lit(0)).alias("others")).first()
    weight = (F.log((F.col("leaks") + 1.0) / float(total.leaks + total.words + 1))
              - F.log((F.col("others") + 1.0) / float(total.others + total.words + 1)))
    prior = rows.sparkSession.range(1).select(F.log(F.lit((docs.leaks + 1.0) / (docs.n - docs.leaks + 1.0)))).first()[0]
    return NaiveBayes(counts.select("word", weight.alias("weight")), prior)


def log_odds(rows: DataFrame, model: NaiveBayes, text: str = "snippet", name: str = "log_odds") -> DataFrame:
    """Add the log odds of a leak to rows with a unique ``id``. Words that were never seen count for nothing; a text without
    a word has the prior."""
    held = rows.select("id", F.explode(words(F.col(text))).alias("word"))
    sums = lookup_join(held, model.weights, "word", F.col("id"), how="inner").groupBy("id").agg(F.sum("weight").alias("_sum"))
    joined = rows.join(sums, "id", "left")
    return joined.select(*rows.columns, (F.coalesce("_sum", F.lit(0.0)) + model.prior).alias(name))


def bayes_model(model: NaiveBayes, category: str | None = "password", least: float = 0.0) -> Model:
    """False positives are texts whose log odds of a leak are below ``least``."""
    def predict(frame: DataFrame, source: str, target: str) -> DataFrame:
        scored = log_odds(frame, model, source, "_odds")
        return scored.withColumn(target, F.col("_odds") < least).drop("_odds")
    return Model(predict, "snippet", category)


def hashed_grams(text: Column, width: int, gram: int = 3) -> Column:
    """Unit vector of signed counts: of the md5 of each n-gram the first eight hex digits choose the place (modulo ``width``),
    the ninth the sign. A text shorter than an n-gram has the zero vector."""
    lowered = F.lower(normalise_quotes(F.coalesce(text, F.lit(""))))

    def vectors(texts: pd.Series) -> pd.Series:
        # A gram's digest is taken once for each batch, however many texts hold it.
        places: dict[str, int] = {}
        cells: list[int] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for row, body in enumerate(texts):
            grams = [body[i:i + gram] for i in range(len(body) - gram + 1)]
            for new in set(grams).difference(places):
                digest = hashlib.md5(new.encode()).hexdigest()
                places[new] = 2 * (int(digest[:8], 16) % width) + (digest[8] < "8")
            cells.extend(map(places.__getitem__, grams))
            sizes[row] = len(grams)
        at, positive = np.divmod(np.array(cells, dtype=np.int64), 2)
        counts = np.bincount(np.repeat(np.arange(len(texts)), sizes) * width + at, weights=2.0 * positive - 1.0,
                             minlength=len(texts) * width).reshape(len(texts), width)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return pd.Series(list(counts / np.where(norms > 0, norms, 1.0)), dtype=object)

    return F.pandas_udf(vectors, "array<double>")(lowered)


def signed_encoder(width: int = 128, gram: int = 3) -> Encoder:
    def encode(frame: DataFrame) -> DataFrame:
        return frame.withColumn("embedding", hashed_grams(F.col("snippet"), width, gram))
    return encode
