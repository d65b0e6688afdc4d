"""False-positive models and snippet encoders.

A model looks at one column of the discoveries and answers, per row, whether it is a
false positive. Built-in models are column expressions or Spark ML pipelines; a user
model is any function that adds a boolean column, for instance through
``pyspark.ml.functions.predict_batch_udf``.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.functions import paths
from keysieve.functions.text import normalise_quotes
from keysieve.operators.skew import lookup_join, salted_join
from keysieve.sources.rules import Rule

logger = logging.getLogger(__name__)

# (frame, input column, output column) -> frame with the boolean output column
Predict = Callable[[DataFrame, str, str], DataFrame]


class Model(NamedTuple):
    predict: Predict
    column: str = "snippet"
    category: str | None = None   # only discoveries of rules of this category


def column_model(expression: Callable[[Column], Column], column: str = "snippet",
                 category: str | None = None) -> Model:
    def predict(frame: DataFrame, source: str, target: str) -> DataFrame:
        return frame.withColumn(target, expression(F.col(source)))
    return Model(predict, column, category)


def batch_model(make_predict_fn: Callable, column: str = "snippet", category: str | None = "password",
                batch_size: int = 8) -> Model:
    """A user classifier over batches of texts; label 0 is a false positive.

    The classifier is loaded once per Python worker.
    """
    score = predict_batch_udf(make_predict_fn, return_type=T.LongType(), batch_size=batch_size)

    def predict(frame: DataFrame, source: str, target: str) -> DataFrame:
        return frame.withColumn(target, score(F.coalesce(F.col(source), F.lit(""))) == 0)
    return Model(predict, column, category)


def once_per_value(model: Model) -> Model:
    """Run a costly model once per distinct input and join the answers back."""
    def predict(frame: DataFrame, source: str, target: str) -> DataFrame:
        values = frame.select(source).filter(F.col(source).isNotNull()).distinct()
        answers = model.predict(values, source, target)
        return salted_join(frame, answers, [source], F.col("id"), how="left")
    return Model(predict, model.column, model.category)


REGISTRY: dict[str, Model] = {
    "path": column_model(paths.is_false_positive_path, column="file_name"),
}


def register_model(name: str, model: Model) -> None:
    REGISTRY[name] = model


def get_model(name: str) -> Model:
    if name not in REGISTRY:
        raise ModuleNotFoundError(f"no model is registered as {name!r}")
    return REGISTRY[name]


def run_models(discoveries: DataFrame, models: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """Run models in the listed order; each may turn ``new`` into ``false_positive``.

    ``flagged_by`` names the model that did so. An unknown model is skipped with a
    warning. Rows outside a model's scope reach it as null.
    """
    frame = discoveries.withColumn("flagged_by", F.lit(None).cast("string"))
    for name in models:
        try:
            model = get_model(name)
        except ModuleNotFoundError:
            logger.warning("Leaving out %r: no such model is registered", name)
            continue
        in_scope = F.col("state") == "new"
        if model.category is not None:
            ids = [rule.id for rule in rules if rule.category == model.category]
            in_scope = in_scope & (F.coalesce(F.col("rule_id").isin(ids), F.lit(False)) if ids else F.lit(False))
        seen = frame.withColumn("_input", F.when(in_scope, F.col(model.column)))
        scored = model.predict(seen, "_input", "_answer")
        flagged = in_scope & F.coalesce(F.col("_answer"), F.lit(False))
        frame = scored.select(
            *[F.when(flagged, "false_positive").otherwise(F.col("state")).alias("state") if c == "state"
              else F.when(flagged, name).otherwise(F.col("flagged_by")).alias("flagged_by") if c == "flagged_by"
              else F.col(c) for c in frame.columns])
    return frame


def password_split(discoveries: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Discoveries of password rules, and all others."""
    passwords = rules.filter(F.col("category") == "password").select(F.col("id").alias("rule_id"))
    return tuple(lookup_join(discoveries, passwords, "rule_id", F.col("id"), how).select(*discoveries.columns)
                 for how in ("left_semi", "left_anti"))


def rejoin(passwords: DataFrame, others: DataFrame) -> DataFrame:
    return passwords.unionByName(others)


def model_counts(classified: DataFrame) -> DataFrame:
    """False positives per model that found them."""
    return (classified.filter(F.col("flagged_by").isNotNull())
            .groupBy(F.col("flagged_by").alias("model")).agg(F.count("*").alias("false_positives")))


def fit_text_model(triaged: DataFrame, features: int = 4096, iterations: int = 20) -> PipelineModel:
    """A bag-of-words classifier learnt from triaged snippets; label 0 is a false positive."""
    labelled = (triaged.filter(F.col("state") != "new")
                .select(F.coalesce("snippet", F.lit("")).alias("_text"),
                        F.when(F.col("state") == "false_positive", 0.0).otherwise(1.0).alias("_label")))
    return Pipeline(stages=[
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_features", numFeatures=features),
        LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_prediction",
                           rawPredictionCol="_raw", probabilityCol="_probability",
                           maxIter=iterations, regParam=0.01),
    ]).fit(labelled)


def text_scores(frame: DataFrame, pipeline: PipelineModel, source: str = "snippet") -> DataFrame:
    """Add ``prediction`` (0 false positive, 1 leak) and ``leak_probability``."""
    scored = pipeline.transform(frame.withColumn("_text", F.coalesce(F.col(source), F.lit(""))))
    return scored.select(*frame.columns, F.col("_prediction").cast("int").alias("prediction"),
                         F.element_at(vector_to_array("_probability"), 2).alias("leak_probability"))


def text_model(pipeline: PipelineModel, category: str | None = "password") -> Model:
    def predict(frame: DataFrame, source: str, target: str) -> DataFrame:
        return (text_scores(frame, pipeline, source)
                .withColumn(target, F.col("prediction") == 0).drop("prediction", "leak_probability"))
    return Model(predict, "snippet", category)


# (frame with id, snippet) -> the same frame with an ``embedding`` array<double>
Encoder = Callable[[DataFrame], DataFrame]


def gram_encoder(width: int = 128, gram: int = 3) -> Encoder:
    """Encode a snippet by its hashed character n-grams, scaled to length 1."""
    def encode(frame: DataFrame) -> DataFrame:
        text = F.lower(normalise_quotes(F.coalesce(F.col("snippet"), F.lit(""))))
        chars = F.col("_chars")
        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - gram, F.lit(0))),
                            lambda i: F.concat_ws("", *[F.get(chars, i + k) for k in range(gram)]))
        cut = frame.withColumn("_chars", F.split(text, "", -1)).withColumn("_grams", grams)
        hashed = HashingTF(inputCol="_grams", outputCol="_counts", numFeatures=width).transform(cut)
        unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(hashed)
        return unit.select(*frame.columns, vector_to_array("_unit").alias("embedding"))
    return encode


def batch_encoder(make_predict_fn: Callable, batch_size: int = 8) -> Encoder:
    """A user encoder over batches of snippets, loaded once per Python worker."""
    embed = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)

    def encode(frame: DataFrame) -> DataFrame:
        return frame.withColumn("embedding", embed(normalise_quotes(F.coalesce(F.col("snippet"), F.lit("")))))
    return encode


def embed_discoveries(discoveries: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Rows of the embeddings table for the given discoveries."""
    encode = encoder or gram_encoder()
    return encode(discoveries.select("id", "snippet", "repo_url")).select("id", "snippet", "embedding", "repo_url")


def without_embedding(discoveries: DataFrame, embeddings: DataFrame) -> DataFrame:
    return discoveries.join(embeddings.select("id"), "id", "left_anti")


def complete_embeddings(discoveries: DataFrame, embeddings: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Stored embeddings plus freshly computed ones for the discoveries without."""
    fresh = embed_discoveries(without_embedding(discoveries, embeddings), encoder)
    return embeddings.select("id", "snippet", "embedding", "repo_url").unionByName(fresh)
