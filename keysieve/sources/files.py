"""File trees and snapshots as rows of files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.functions import paths
from keysieve.operators.skew import salted_join, spread
from keysieve.sources import trees
from keysieve.sources.commits import resolve_refs
from keysieve.sources.repos import of_commits


def _without_scheme(path: str) -> str:
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")


def read_tree(spark: SparkSession, root: str, max_depth: int = -1, ignore_list: Sequence[str] = (),
              repo_url: str | None = None) -> DataFrame:
    """All files below ``root``, or the one file it names, with paths relative to it, each as one row.

    A missing path raises FileNotFoundError. Unwanted files are pruned by path before
    their content is read. Where only Spark's readers can open the store, names that
    start with a dot or an underscore are not seen.
    """
    if trees.can_open(root):
        found = trees.read_whole(trees.list_tree(spark, root, max_depth, ignore_list), root)
    else:
        found = spread(_read_with_spark(spark, root).filter(paths.keep_path(F.col("file_name"), max_depth, ignore_list)))
    return found.select(F.lit(repo_url or root).alias("repo_url"), F.lit("").alias("commit_id"), "file_name", "content")


def _read_with_spark(spark: SparkSession, root: str) -> DataFrame:
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except AnalysisException as error:
        raise FileNotFoundError(f"{root} does not exist") from error
    base = _without_scheme(root)
    path = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*(?=/))?", "")
    inside = F.substring(path, F.lit(len(base) + 2), F.lit(2147483647))
    name = F.when(path == base, F.element_at(F.split(path, "/"), -1)).otherwise(inside)
    return found.select(name.alias("file_name"), "content")


def prune(files: DataFrame, max_depth: int = -1, ignore_list: Sequence[str] = ()) -> DataFrame:
    return files.filter(paths.keep_path(F.col("file_name"), max_depth, ignore_list))


def snapshot_files(files: DataFrame, refs: DataFrame, requests: DataFrame, max_depth: int = -1,
                   ignore_list: Sequence[str] = ()) -> DataFrame:
    """The files of every requested (repo_url, name), a branch or commit."""
    wanted = resolve_refs(requests, refs).select("repo_url", "commit_id").distinct()
    return in_snapshots(of_commits(prune(files, max_depth, ignore_list), wanted), wanted)


def in_snapshots(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted (repo_url, commit_id); one commit may hold most rows."""
    return salted_join(rows, wanted, ["repo_url", "commit_id"], F.col("file_name"), how="left_semi").select(*rows.columns)
