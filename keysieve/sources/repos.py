"""Which repositories a scan covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.functions import paths
from keysieve.operators.skew import salted_join

# Up to this many values become a literal condition, which the scan itself can use.
MAX_LITERALS = 1000


def _literals(values: DataFrame, column: str) -> list | None:
    rows = values.select(column).dropna().distinct().limit(MAX_LITERALS + 1).collect()
    return None if len(rows) > MAX_LITERALS else [row[0] for row in rows]


def of_repos(frame: DataFrame, urls: DataFrame, spread: str, column: str = "repo_url") -> DataFrame:
    """The rows of the listed repositories (``url``).

    A few repositories are named in the scan's condition, ahead of any costly one;
    many are joined, with the rows of a large repository spread by ``spread``.
    """
    listed = _literals(urls, "url")
    if listed is not None:
        return frame.filter(F.col(column).isin(listed))
    keys = urls.select(F.col("url").alias(column)).dropna().distinct()
    return salted_join(frame, keys, [column], F.col(spread), how="left_semi").select(*frame.columns)


def without_repos(frame: DataFrame, urls: DataFrame, spread: str, column: str = "repo_url") -> DataFrame:
    """All rows but those of the listed repositories. A null url, on either side, is no repository."""
    listed = _literals(urls, "url")
    if listed is not None:
        return frame.filter(F.col(column).isNull() | ~F.col(column).isin(listed))
    keys = urls.select(F.col("url").alias(column)).dropna().distinct()
    return salted_join(frame, keys, [column], F.col(spread), how="left_anti").select(*frame.columns)


def of_commits(frame: DataFrame, commits: DataFrame) -> DataFrame:
    """The rows of the listed commits, where they are few enough to name; else all."""
    listed = _literals(commits, "commit_id")
    return frame if listed is None else frame.filter(F.col("commit_id").isin(listed))


def repos_of(repos_meta: DataFrame, owner: str, forks: bool = False) -> DataFrame:
    """The repositories of a user or organisation; forks only on request."""
    chosen = repos_meta.filter(F.col("owner") == owner)
    return chosen if forks else chosen.filter(~F.col("fork"))


def wiki_repos(repos: DataFrame, url: str = "url") -> DataFrame:
    return repos.withColumn(url, paths.wiki_url(F.col(url)))
