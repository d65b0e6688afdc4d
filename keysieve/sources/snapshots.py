"""Differences of any two snapshots, from the files of both."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.operators.line_diff import hunks, split_lines
from keysieve.operators.skew import salted_join

FILE = ["repo_url", "commit_from", "commit_id", "file_name"]
_DIFF = "struct<hunks:array<struct<old_from:int,removed:array<string>,new_from:int,added:array<string>>>,newline:boolean>"
_ARROW = pa.struct([("hunks", pa.list_(pa.struct([
    ("old_from", pa.int32()), ("removed", pa.list_(pa.string())), ("new_from", pa.int32()), ("added", pa.list_(pa.string()))]))),
    ("newline", pa.bool_())])


def _differences(ignore_space: bool):
    @F.arrow_udf(_DIFF)
    def differences(old: pa.Array, new: pa.Array) -> pa.Array:
        return pa.array([{"hunks": hunks(split_lines(a)[0], split_lines(b)[0], ignore_space), "newline": split_lines(b)[1]}
                         for a, b in zip(old.to_pylist(), new.to_pylist())], _ARROW)
    return differences


def _sides(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """The files of both commits of every pair; ``new`` tells which side a row is."""
    both = pairs.select("repo_url", "commit_from", F.col("commit_id").alias("_to"), F.inline(F.array(
        F.struct(F.col("commit_from").alias("commit_id"), F.lit(False).alias("new")),
        F.struct(F.col("commit_id"), F.lit(True).alias("new"))))).filter(F.col("commit_from") != F.col("_to")).distinct()
    return salted_join(files, both, ["repo_url", "commit_id"], F.col("file_name"))


def changed_files(files: DataFrame, pairs: DataFrame, content: str = "content") -> DataFrame:
    """(repo_url, commit_from, commit_id, file_name, old, new) of files whose text differs between the commits of a pair
    (repo_url, commit_from, commit_id); ``old`` or ``new`` is null where there is no such file.

    Only digests of unchanged files are shuffled. ``files`` has (repo_url, commit_id, file_name, text).
    """
    digests = _sides(files.select("repo_url", "commit_id", "file_name", F.sha2(F.col(content), 256).alias("_digest")), pairs)
    keys = ["repo_url", "commit_from", "_to", "file_name"]
    differing = (digests.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_digest").alias("_low"), F.max("_digest").alias("_high"))
                 .filter((F.col("_n") == 1) | (F.col("_low") != F.col("_high"))).select(*keys))
    texts = _sides(files.select("repo_url", "commit_id", "file_name", F.col(content).alias("_text")), pairs)
    return (texts.join(differing, keys, "left_semi").groupBy(*keys)
            .agg(F.max(F.when(~F.col("new"), F.col("_text"))).alias("old"), F.max(F.when(F.col("new"), F.col("_text"))).alias("new"))
            .select("repo_url", "commit_from", F.col("_to").alias("commit_id"), "file_name", "old", "new"))


def snapshot_diff(files: DataFrame, pairs: DataFrame, content: str = "content", ignore_space: bool = False) -> DataFrame:
    """(repo_url, commit_from, commit_id, file_name, change_type, hunks, newline) of files that differ; A, M or D.

    A hunk has the places (from 0) of its removed and added lines on both sides, and the lines without their newline;
    ``newline`` tells whether the new text ends with one. Files are paired by path, and lines end at line feeds.
    ``ignore_space`` takes lines for equal that differ in white space only.
    """
    kind = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").otherwise("M")
    return changed_files(files, pairs, content).select(
        *FILE, kind.alias("change_type"), _differences(ignore_space)("old", "new").alias("_d")).select(
        *FILE, "change_type", "_d.hunks", "_d.newline")


def added_lines(diff: DataFrame) -> DataFrame:
    """(repo_url, commit_from, commit_id, file_name, line_number, line): what a diff adds, numbered in the new file."""
    rows = (diff.select(*FILE, F.inline("hunks"))
            .select(*FILE, "new_from", F.posexplode("added").alias("_at", "line")))
    return rows.select(*FILE, (F.col("new_from") + F.col("_at") + 1).alias("line_number"), "line")


def _signed(lines: Column, sign: str) -> Column:
    return F.transform(lines, lambda line: F.concat(F.lit(sign), line))


def _range(start: Column, lines: Column) -> Column:
    """Start and length as in a hunk header: an empty side stands behind the line before it."""
    first = F.when(F.size(lines) > 0, start + 1).otherwise(start)
    return F.concat(first.cast("string"), F.lit(","), F.size(lines).cast("string"))


def diff_patches(diff: DataFrame) -> DataFrame:
    """The diff as patches without context: (repo_url, commit_id, parent_id, change_type, a_path, b_path, patch)."""
    def rows(hunk: Column) -> Column:
        header = F.concat(F.lit("@@ -"), _range(hunk["old_from"], hunk["removed"]), F.lit(" +"),
                          _range(hunk["new_from"], hunk["added"]), F.lit(" @@"))
        return F.array_join(F.concat(F.array(header), _signed(hunk["removed"], "-"), _signed(hunk["added"], "+")), "\n")

    name, kind = F.col("file_name"), F.col("change_type")
    return diff.select("repo_url", "commit_id", F.col("commit_from").alias("parent_id"), "change_type",
                       F.when(kind != "A", name).alias("a_path"), F.when(kind != "D", name).alias("b_path"),
                       F.array_join(F.transform("hunks", rows), "\n").alias("patch"))
