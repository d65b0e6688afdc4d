"""Schemas and closed value sets shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# The triage states and rule categories users already store.
STATES = ("new", "false_positive", "addressing", "not_relevant", "fixed")
CATEGORIES = ("password", "token", "crypto_key", "other")

RULES = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("regex", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
])

REPOS = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("last_scan", T.LongType(), True),
])

DISCOVERIES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("file_name", T.StringType(), False),
    T.StructField("commit_id", T.StringType(), False),
    T.StructField("line_number", T.IntegerType(), True),
    T.StructField("snippet", T.StringType(), True),
    T.StructField("repo_url", T.StringType(), False),
    T.StructField("rule_id", T.IntegerType(), True),
    T.StructField("state", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), True),
])

EMBEDDINGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("snippet", T.StringType(), True),
    T.StructField("embedding", T.ArrayType(T.DoubleType()), False),
    T.StructField("repo_url", T.StringType(), False),
])

FILES = T.StructType([
    T.StructField("repo_url", T.StringType(), False),
    T.StructField("commit_id", T.StringType(), False),
    T.StructField("file_name", T.StringType(), False),
    T.StructField("content", T.BinaryType(), True),
])

# One row per commit of a branch; pos is 0 for the newest commit and has no gaps.
COMMITS = T.StructType([
    T.StructField("repo_url", T.StringType(), False),
    T.StructField("branch", T.StringType(), False),
    T.StructField("pos", T.LongType(), False),
    T.StructField("commit_id", T.StringType(), False),
    T.StructField("committed_date", T.LongType(), False),
])

# One row per file touched between parent_id and commit_id; parent_id is null for
# the diff of a first commit against the empty tree.
PATCHES = T.StructType([
    T.StructField("repo_url", T.StringType(), False),
    T.StructField("commit_id", T.StringType(), False),
    T.StructField("parent_id", T.StringType(), True),
    T.StructField("committed_date", T.LongType(), True),
    T.StructField("change_type", T.StringType(), True),
    T.StructField("a_path", T.StringType(), True),
    T.StructField("b_path", T.StringType(), True),
    T.StructField("patch", T.StringType(), True),
])

REFS = T.StructType([
    T.StructField("repo_url", T.StringType(), False),
    T.StructField("ref_name", T.StringType(), False),
    T.StructField("commit_id", T.StringType(), False),
])

PR_COMMITS = T.StructType([
    T.StructField("repo_url", T.StringType(), True),
    T.StructField("pr_number", T.IntegerType(), True),
    T.StructField("sha", T.StringType(), True),
    T.StructField("files", T.ArrayType(T.StructType([
        T.StructField("filename", T.StringType(), True),
        T.StructField("patch", T.StringType(), True),
    ])), True),
])


def require_state(state: str) -> str:
    if state not in STATES:
        raise ValueError(f"unknown state {state!r}, expected one of {', '.join(STATES)}")
    return state
