"""Commit chains: which pairs of commits a history scan has to look at.

Commits come as one row per (repository, branch, pos), pos 0 being the newest.
A pair is a commit and its parent on the branch; what the pair introduced is
reported on the commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keysieve.operators.skew import salted_join

BRANCH = ["repo_url", "branch"]
PAIR = ["repo_url", "commit_id", "parent_id"]
BLOCK = 50_000


def commit_chain(commits: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``parent_id``, the next older commit; null for the oldest of a branch.

    The window runs over blocks of ``block`` positions. The first commit of a block is
    repeated at the end of the block before it, where it only serves as a parent, so
    a branch of any length is spread over many tasks with a single shuffle.
    """
    own = F.floor(F.col("pos") / block)
    borders = F.when((F.col("pos") % block == 0) & (F.col("pos") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    placed = commits.withColumn("_block", F.explode_outer(borders))
    parent = F.lead("commit_id").over(W.partitionBy(*BRANCH, "_block").orderBy("pos"))
    return (placed.withColumn("parent_id", parent)
            .filter(F.floor(F.col("pos") / block) == F.col("_block")).drop("_block"))


def commit_pairs(commits: DataFrame) -> DataFrame:
    return commit_chain(commits).filter(F.col("parent_id").isNotNull())


def newest_commits(commits: DataFrame, max_depth: int) -> DataFrame:
    """At most ``max_depth`` commits per branch."""
    return commits.filter(F.col("pos") < max_depth)


def _with_stop(commits: DataFrame, since: int | Column) -> DataFrame:
    """Add ``_stop``, the first position of a branch whose commit is not newer than
    ``since``; null where there is none. A stop is one minimum per branch."""
    bound = since if isinstance(since, Column) else F.lit(since)
    stops = (commits.filter(F.col("committed_date") <= bound)
             .groupBy(*BRANCH).agg(F.min("pos").alias("_stop")))
    return salted_join(commits, stops, BRANCH, F.col("pos"), how="left")


def commits_since(pairs: DataFrame, since: int | Column = 0) -> DataFrame:
    """Pairs ahead of the first one whose commit is not newer than ``since``.

    This is a stop, not a filter: commit dates need not fall along a branch.
    """
    ahead = F.col("_stop").isNull() | (F.col("pos") < F.col("_stop"))
    return _with_stop(pairs, since).filter(ahead).select(*pairs.columns)


def pairs_since(commits: DataFrame, since: int | Column = 0) -> DataFrame:
    """The same pairs straight from the commits: each branch is cut behind its stop, which
    is the parent of the last pair, before neighbours are looked up."""
    kept = F.col("_stop").isNull() | (F.col("pos") <= F.col("_stop"))
    return commit_pairs(_with_stop(commits, since).filter(kept).select(*commits.columns))


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """Every pair once, credited to the first branch it is on."""
    rest = [c for c in pairs.columns if c not in PAIR]
    first = F.min(F.struct("branch", *[c for c in rest if c != "branch"])).alias("_first")
    grouped = pairs.groupBy(*PAIR).agg(first)
    return grouped.select(*[F.col(c) if c in PAIR else F.col(f"_first.{c}").alias(c) for c in pairs.columns])


def new_pairs_only(pairs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Pairs that no earlier scan has seen."""
    return pairs.join(scanned.select(*PAIR), PAIR, "left_anti")


def root_commits(commits: DataFrame) -> DataFrame:
    """The oldest listed commit of every branch, once per repository and commit."""
    oldest = commits.groupBy(*BRANCH).agg(F.max_by("commit_id", "pos").alias("commit_id"))
    return oldest.select("repo_url", "commit_id").distinct()


def resolve_refs(requests: DataFrame, refs: DataFrame) -> DataFrame:
    """Resolve ``name`` of (repo_url, name) to a commit id.

    A name stands for every ref that ends in it at a ``/``; the first such ref wins.
    A name without a ref is taken to be a commit id.
    """
    parts = F.split("ref_name", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)),
                          lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    first = (refs.select("repo_url", "ref_name", "commit_id", F.explode_outer(endings).alias("name"))
             .groupBy("repo_url", "name").agg(F.min_by("commit_id", "ref_name").alias("_head")))
    return (requests.join(first, ["repo_url", "name"], "left")
            .withColumn("commit_id", F.coalesce("_head", "name")).drop("_head"))


def commit_timestamps(requests: DataFrame, refs: DataFrame, commits: DataFrame) -> DataFrame:
    """The commit date of every requested branch or commit."""
    dates = commits.groupBy("repo_url", "commit_id").agg(F.min("committed_date").alias("committed_date"))
    return resolve_refs(requests, refs).join(dates, ["repo_url", "commit_id"])


def last_commit_before(commits: DataFrame, repos: DataFrame) -> DataFrame:
    """Per repository the newest commit dated at or before its ``last_scan``."""
    known = repos.select(F.col("url").alias("repo_url"), "last_scan").filter(F.col("last_scan") > 0)
    return (salted_join(commits, known, ["repo_url"], F.col("commit_id")).filter(F.col("committed_date") <= F.col("last_scan"))
            .groupBy("repo_url").agg(F.max_by("commit_id", F.struct("committed_date", "commit_id")).alias("commit_from")))


def unknown_snapshots(resolved: DataFrame, *known: DataFrame) -> DataFrame:
    """The resolved requests whose commit is in none of the ``known`` tables (repo_url, commit_id)."""
    left = resolved
    for frame in known:
        left = left.join(frame.select("repo_url", "commit_id").distinct(), ["repo_url", "commit_id"], "left_anti")
    return left


def landed_deltas(delta: DataFrame, patches: DataFrame) -> DataFrame:
    """The (repo_url, commit_id) of a delta that needs no other scan: its patch is landed, or nothing has changed."""
    pairs = delta.select("repo_url", "commit_id", F.col("commit_from").alias("parent_id"))
    landed = pairs.join(patches.select(*PAIR).distinct(), PAIR, "left_semi")
    return pairs.filter(F.col("commit_id") == F.col("parent_id")).unionByName(landed).select("repo_url", "commit_id").distinct()


def snapshot_delta(commits: DataFrame, repos: DataFrame, targets: DataFrame) -> DataFrame:
    """(repo_url, commit_from, commit_id): what a repeated snapshot scan has to diff.

    Repositories without an earlier scan drop out here and are scanned whole.
    """
    return targets.select("repo_url", "commit_id").join(last_commit_before(commits, repos), "repo_url")
