"""State changes and deletions as DataFrame -> DataFrame transforms.

Nothing is updated in place: the caller writes the result with ``tables.replace``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.operators.similarity import THRESHOLD, similar_to_requests, similar_to_target
from keysieve.operators.skew import lookup_join
from keysieve.schemas import STATES, require_state
from keysieve.sources.repos import without_repos

# An id list up to this length is a literal of the plan; a longer one comes as a frame.
MAX_LITERAL_IDS = 1000


def valid_state(state: Column) -> Column:
    return state.isin(*STATES)


def _set_state(discoveries: DataFrame, condition: Column, state: str | Column) -> DataFrame:
    value = F.lit(state) if isinstance(state, str) else state
    chosen = F.coalesce(condition, F.lit(False))
    return discoveries.withColumn("state", F.when(chosen, value).otherwise(F.col("state")))


def update_discovery(discoveries: DataFrame, discovery_id: int, state: str) -> DataFrame:
    return _set_state(discoveries, F.col("id") == discovery_id, require_state(state))


def update_discoveries(discoveries: DataFrame, ids: Sequence[int] | DataFrame, state: str) -> DataFrame:
    """Set the state of listed ids, given as a short list or as a frame with ``id``."""
    require_state(state)
    if not isinstance(ids, DataFrame):
        if len(ids) <= MAX_LITERAL_IDS:
            return _set_state(discoveries, F.col("id").isin(list(ids)), state)
        ids = discoveries.sparkSession.createDataFrame([(i,) for i in ids], "id bigint")
    listed = ids.select("id").distinct().withColumn("_listed", F.lit(True))
    return _set_state(discoveries.join(listed, "id", "left"), F.col("_listed"), state).select(*discoveries.columns)


def update_discovery_group(discoveries: DataFrame, state: str, repo_url: str, file_name: str | None = None,
                           snippet: str | None = None) -> DataFrame:
    """Set the state of a repository's discoveries, or of those in a file or of a snippet."""
    require_state(state)
    condition = F.col("repo_url") == repo_url
    if file_name is not None:
        condition = condition & (F.col("file_name") == file_name)
    if snippet is not None:
        condition = condition & (F.col("snippet") == snippet)
    return _set_state(discoveries, condition, state)


def similar_discoveries(discoveries: DataFrame, embeddings: DataFrame, snippet: str, state: str,
                        repo_url: str, file_name: str | None = None,
                        threshold: float = THRESHOLD) -> DataFrame:
    """Ids an update of similar snippets would change: not in the state yet."""
    require_state(state)
    open_ids = discoveries.filter((F.col("repo_url") == repo_url) & (F.col("state") != state))
    if file_name is not None:
        open_ids = open_ids.filter(F.col("file_name") == file_name)
    similar = similar_to_target(embeddings, snippet, repo_url, threshold)
    return similar.join(open_ids.select("id"), "id", "left_semi").select("id")


def update_similar(discoveries: DataFrame, embeddings: DataFrame, snippet: str, state: str,
                   repo_url: str, file_name: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    ids = similar_discoveries(discoveries, embeddings, snippet, state, repo_url, file_name, threshold)
    return update_discoveries(discoveries, ids, state)


def update_group_and_similar(discoveries: DataFrame, embeddings: DataFrame, snippet: str, state: str,
                             repo_url: str, file_name: str | None = None,
                             threshold: float = THRESHOLD) -> DataFrame:
    """Set a snippet's group in a file, then everything similar in the repository."""
    grouped = update_discovery_group(discoveries, state, repo_url, file_name, snippet)
    return update_similar(grouped, embeddings, snippet, state, repo_url, threshold=threshold)


def update_similar_batch(discoveries: DataFrame, embeddings: DataFrame, requests: DataFrame,
                         threshold: float = THRESHOLD) -> DataFrame:
    """Many similarity updates (request_id, repo_url, snippet, state) at once.

    Where several requests reach one discovery the highest request id decides.
    """
    decided = (similar_to_requests(embeddings, requests, threshold)
               .join(requests.select("request_id", F.col("state").alias("_state")), "request_id")
               .groupBy("id").agg(F.max_by("_state", "request_id").alias("_state")))
    joined = discoveries.join(decided, "id", "left")
    return _set_state(joined, valid_state(F.col("_state")), F.col("_state")).select(*discoveries.columns)


def delete_discoveries(discoveries: DataFrame, repo_url: str) -> DataFrame:
    return discoveries.filter(~F.col("repo_url").eqNullSafe(F.lit(repo_url)))


def delete_repo(repos: DataFrame, discoveries: DataFrame, embeddings: DataFrame,
                urls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop repositories (``url``) together with their discoveries and embeddings."""
    return (without_repos(repos, urls, "url", "url"), without_repos(discoveries, urls, "id"),
            without_repos(embeddings, urls, "id"))


def delete_rules(rules: DataFrame, discoveries: DataFrame, ids: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Drop rules; their discoveries stay, without a rule."""
    gone = F.col("rule_id").isin(list(ids))
    return (rules.filter(~F.col("id").isin(list(ids))),
            discoveries.withColumn("rule_id", F.when(~gone, F.col("rule_id"))))


def null_missing_rules(discoveries: DataFrame, rules: DataFrame) -> DataFrame:
    """Forget rule ids that are not in the catalogue any more."""
    known = rules.select(F.col("id").alias("rule_id"), F.lit(True).alias("_known"))
    joined = lookup_join(discoveries, known, "rule_id", F.col("id"))
    return joined.withColumn("rule_id", F.when(F.col("_known"), F.col("rule_id"))).select(*discoveries.columns)


def delete_embeddings(embeddings: DataFrame, ids: Sequence[int] | None = None,
                      repo_url: str | None = None) -> DataFrame:
    if repo_url is not None:
        return embeddings.filter(~F.col("repo_url").eqNullSafe(F.lit(repo_url)))
    return embeddings.filter(F.col("id").isNull() | ~F.col("id").isin(list(ids or [])))


def upsert_repos(repos: DataFrame, updates: DataFrame) -> DataFrame:
    """Add repositories and advance ``last_scan`` of known ones."""
    news = updates.groupBy("url").agg(F.max("last_scan").alias("_new"))
    return (repos.join(news, "url", "full_outer")
            .select("url", F.coalesce("_new", "last_scan").alias("last_scan")))
