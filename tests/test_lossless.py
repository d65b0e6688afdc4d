"""Cases that must neither be lost nor end a job."""

import pytest
from pyspark.sql import functions as F

from keysieve import scan_files
from keysieve.functions import paths, text, vectors
from keysieve.operators import matching
from keysieve.operators.triage import delete_discoveries
from keysieve.plans.scans import scan_patches
from keysieve.sources import repos
from keysieve.sources.rules import Rule
from keysieve.streaming import jobs


@pytest.mark.parametrize("pattern, body", [
    (r"pw[\W_]", "my pw\nx\n"), (r"\d{6}\s", "id 123456\r\nx"), (r"secret\p{L}*", "a secret\n"), (r"abc\x41*", "abcAAA\n"),
    (r"re\W", "more\nx"), (r"key+", "keyyy")])
def test_the_gate_keeps_what_the_rule_matches(spark, pattern, body):
    files = spark.createDataFrame([("u", "c", "f", body)], "repo_url string, commit_id string, file_name string, content string")
    assert scan_files(files, [Rule(1, pattern, "token", "")]).count() == 1


def test_existence_pattern_leaves_long_escapes_alone():
    for pattern in (r"secret\p{L}*", r"abc\x41*"):
        assert matching.existence_pattern(pattern) == pattern


@pytest.mark.parametrize("most", [1, 1000])
def test_a_null_url_is_no_repository_at_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(repos, "MAX_LITERALS", most)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id long, repo_url string")
    listed = spark.createDataFrame([("a",), (None,), ("b",)], "url string")
    assert {r["id"] for r in repos.without_repos(rows, listed, "id").collect()} == {3, 4}
    assert {r["id"] for r in repos.of_repos(rows, listed, "id").collect()} == {1, 2}
    assert {r["id"] for r in delete_discoveries(rows, "a").collect()} == {2, 3, 4}


def test_odd_inputs_give_nulls(spark):
    row = spark.range(1).select(
        text.hunk_first_line(F.lit("@@ -1 +99999999999 @@")).alias("line"), text.is_hunk_header(F.lit("@@ -1 +99999999999 @@")).alias("header"),
        paths.owner(F.lit("x")).alias("owner"), vectors.mean_pool(F.array().cast("array<array<double>>")).alias("mean")).first()
    assert tuple(row) == (None, False, None, None)
    patch = spark.createDataFrame([("u", "c", "f", "@@ -1 +99999999999 @@\n+ password")], "repo_url string, commit_id string, file_name string, patch string")
    scan_patches(patch, [Rule(1, "password", "password", "")]).collect()


def test_late_pairs_come_through_once(spark, tmp_path):
    landed, target, progress = (f"{tmp_path}/{n}" for n in ("landed", "target", "progress"))
    for day in ("2026-01-01", "2025-01-01", "2024-01-01"):
        new = spark.createDataFrame([("u", day, None, day), ("u", "same", "p", day)], "a string, b string, c string, d string")
        new.select(*[F.col(x).alias(y) for x, y in zip("abc", jobs.PAIR)], F.to_timestamp("d").alias("seen_at")).write.mode("append").parquet(landed)
        jobs.unique_pair_stream(spark, landed, target, progress)
    found = spark.read.schema(jobs.PAIRS).parquet(target)
    assert found.count() == 4 and found.select(*jobs.PAIR).distinct().count() == 4
