"""Finding discoveries whose snippet resembles a target snippet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.functions import vectors
from keysieve.operators.skew import salted_join

# Fixed value: similarity a snippet must exceed to count as similar.
THRESHOLD = 0.96


def embedding_by_snippet(embeddings: DataFrame, snippet: str) -> DataFrame:
    """The embedding of a snippet, whatever its repository; the smallest id wins."""
    return (embeddings.filter(F.col("snippet") == snippet)
            .agg(F.min("id").alias("id"), F.min_by("embedding", "id").alias("embedding"))
            .filter(F.col("id").isNotNull()))


def similar_to_target(embeddings: DataFrame, snippet: str, repo_url: str,
                      threshold: float = THRESHOLD) -> DataFrame:
    """(id, similarity) of the repository's vectors above the threshold.

    The target vector is a scalar subquery, evaluated once; the vectors are scanned
    once and not shuffled.
    """
    target = embedding_by_snippet(embeddings, snippet).select("embedding").scalar()
    compared = embeddings.filter(F.col("repo_url") == repo_url).withColumn("_target", target)
    scored = compared.select("id", vectors.cosine(F.col("embedding"), F.col("_target")).alias("similarity"))
    return scored.filter(F.col("similarity") > threshold)


def similar_to_requests(embeddings: DataFrame, requests: DataFrame, threshold: float = THRESHOLD,
                        salts: int = 32) -> DataFrame:
    """The same for many requests (request_id, repo_url, snippet) in one job.

    Every vector of a repository meets the few requests made for that repository; a
    large repository is spread over ``salts`` tasks, and only pairs above the threshold
    leave the join.
    """
    first = (embeddings.join(requests.select("snippet").distinct(), "snippet", "left_semi")
             .groupBy("snippet").agg(F.min_by("embedding", "id").alias("target")))
    targets = (requests.join(first, "snippet")
               .select("request_id", "repo_url", "target", vectors.norm(F.col("target")).alias("target_norm")))
    measured = embeddings.select("id", "repo_url", "embedding", vectors.norm(F.col("embedding")).alias("norm"))
    met = salted_join(measured, targets, ["repo_url"], F.col("id"), salts)
    lengths = F.col("norm") * F.col("target_norm")
    scored = met.select("request_id", "repo_url", "id", F.when(
        lengths > 0, vectors.dot(F.col("embedding"), F.col("target")) / lengths).alias("similarity"))
    return scored.filter(F.col("similarity") > threshold)
