"""Patches of commits, of pull requests and of staged changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve import schemas
from keysieve.functions.text import PATCH_ROW_BREAK


def text_patches(patches: DataFrame) -> DataFrame:
    """Name the touched file and leave out binary patches."""
    named = patches.withColumn("file_name", F.coalesce("b_path", "a_path")).drop("a_path", "b_path")
    return named.filter(~F.col("patch").startswith("Binary files"))


def _between_commits() -> Column:
    return F.col("parent_id").isNotNull() & F.col("change_type").isin("A", "M")


def patch_rows(patches: DataFrame) -> DataFrame:
    """Patches between two commits: added and modified files only."""
    return text_patches(patches.filter(_between_commits()))


def root_patches(patches: DataFrame) -> DataFrame:
    """Patches of a first commit against the empty tree, whatever the change type."""
    return text_patches(patches.filter(F.col("parent_id").isNull()))


def history_patches(patches: DataFrame) -> DataFrame:
    """Both kinds in one pass."""
    return text_patches(patches.filter(F.col("parent_id").isNull() | _between_commits()))


def read_pull_requests(spark: SparkSession, path: str) -> DataFrame:
    """Commit documents of pull requests, as JSON lines."""
    return spark.read.schema(schemas.PR_COMMITS).json(path)


def pull_request_patches(pr_commits: DataFrame) -> DataFrame:
    """One row per file of a pull-request commit; files without a patch are skipped."""
    files = pr_commits.select("repo_url", "pr_number", F.col("sha").alias("commit_id"),
                              F.inline_outer("files").alias("file_name", "patch"))
    return files.filter(F.col("patch").isNotNull())


def staged_files(name_status: DataFrame) -> DataFrame:
    """Staged files that were neither deleted nor renamed."""
    return name_status.filter(~F.substring("status", 1, 1).isin("D", "R"))


def added_lines(diffs: DataFrame, diff: str = "diff") -> DataFrame:
    """The added lines of a staged diff, without their sign, numbered from 1 per file.

    The added lines of one file stand in for the file itself, so a line's number is
    its place among them.
    """
    keep = [c for c in diffs.columns if c != diff]
    rows = F.filter(F.split(F.col(diff), PATCH_ROW_BREAK, -1),
                    lambda row: row.startswith("+") & ~row.startswith("+++"))
    return (diffs.select(*keep, F.posexplode_outer(rows).alias("_pos", "_row"))
            .filter(F.col("_row").isNotNull())
            .select(*keep, (F.col("_pos") + 1).alias("line_number"),
                    F.substring("_row", 2, 2147483647).alias("line")))
