"""Numbering and trimming of file lines and patch rows."""

import random

from pyspark.sql import functions as F

from keysieve import DEFAULT_RULES, scan_files, scan_patches
from keysieve.operators.lines import decode_utf8, file_lines, hunk_headers, patch_lines
from keysieve.sources.patches import added_lines, pull_request_patches, read_pull_requests


def patch_frame(spark, *patches):
    return spark.createDataFrame([("r", "c", f"f{i}", p) for i, p in enumerate(patches)],
                                 "repo_url string, commit_id string, file_name string, patch string")


def found(spark, *patches, **options):
    rows = scan_patches(patch_frame(spark, *patches), DEFAULT_RULES, **options).collect()
    return sorted((r.file_name, r.line_number, r.snippet) for r in rows)


def test_new_side_line_numbers(spark):
    two_hunks = "@@ -7,2 +41,3 @@ class Conn\n-host = 'old'\n+host = 'new'\n+pwd = one\n+port = 1\n@@ -88 +90 @@\n-x\n+pwd = two"
    only_removed = "@@ -5,2 +4,0 @@\n-pwd = three\n-pwd = four"
    assert found(spark, two_hunks, only_removed) == [("f0", 42, "pwd = one"), ("f0", 90, "pwd = two")]


def test_skipped_blank_context_and_odd_rows(spark):
    patch = "\n".join([
        "+ pwd before any header", "@@ -1 +10,9 @@ password", "+" + "pwd" * 200, "+pwd" + "x" * 496, "+   ",
        " context passwd ", "-pwd gone", "@@ not a header pwd", "\\ No newline pwd", "+\tpwd\t", ""])
    assert found(spark, patch) == [
        ("f0", 1, "+ pwd before any header"[2:]), ("f0", 10, "pwd" + "x" * 496), ("f0", 12, " context passwd "),
        ("f0", 13, "@@ not a header pwd"), ("f0", 14, "\\ No newline pwd"), ("f0", 15, "pwd")]
    # Counting overlong rows moves everything behind them down by one.
    assert [n for _, n, _ in found(spark, patch, count_long_rows=True)] == [1, 11, 13, 14, 15, 16]


def test_patch_rows_split_on_all_line_ends(spark):
    breaks = ["\r\n", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    patch = "@@ -0,0 +1 @@\n" + "".join(f"+row{i}{b}" for i, b in enumerate(breaks))
    rows = patch_lines(patch_frame(spark, patch)).collect()
    assert [(r.line_number, r.snippet) for r in rows] == [(i + 1, f"row{i}") for i in range(len(breaks))]


def test_patch_numbering_against_row_walk(spark):
    rng = random.Random(3)
    kinds = ["+a", "-b", " c", "+" + "y" * 501, "@@ -1 +{n} @@", "@@ -4,2 +{n},3 @@ def f()", "@@ odd", "+", ""]
    patches = ["\n".join(rng.choice(kinds).format(n=rng.randint(1, 99)) for _ in range(rng.randint(0, 40)))
               for _ in range(60)]
    got = {}
    for row in patch_lines(patch_frame(spark, *patches)).collect():
        got.setdefault(row.file_name, []).append((row.line_number, row.row))
    for i, patch in enumerate(patches):
        expected, at = [], 1
        for row in patch.splitlines():
            if row[:1] == "-" or len(row) > 500:
                continue
            header = row.startswith("@@ -")
            if header:
                at = int(row.split("+")[1].split(",")[0].split(" ")[0])
            else:
                expected.append((at, row))
                at += 1
        assert sorted(got.get(f"f{i}", [])) == sorted(expected)
    headers = hunk_headers(patch_frame(spark, *patches)).count()
    assert headers == sum(row.startswith("@@ -") for p in patches for row in p.splitlines())


def test_file_lines(spark):
    frame = spark.createDataFrame(
        [("r", "", "a", "x\r\n  pass\n\rpass"), ("r", "", "b", ""), ("r", "", "c", "pass\n"), ("r", "", "d", "\u00a0pwd\x1f")],
        "repo_url string, commit_id string, file_name string, content string")
    rows = sorted((r.file_name, r.line_number, r.match_text, r.snippet) for r in file_lines(frame).collect())
    assert rows == [("a", 1, "x\n", "x"), ("a", 2, "  pass\n", "pass"), ("a", 3, "\n", ""), ("a", 4, "pass", "pass"),
                    ("c", 1, "pass\n", "pass"), ("d", 1, "\u00a0pwd\x1f", "pwd")]
    # A newline counts as the character the password rule wants after 'pass'.
    hits = sorted((r.file_name, r.line_number) for r in scan_files(frame, DEFAULT_RULES).collect())
    assert hits == [("a", 2), ("c", 1), ("d", 1)]


def test_undecodable_files_are_dropped_whole(spark):
    frame = spark.createDataFrame([("a", bytearray(b"password\n\xff")), ("b", bytearray("p\u00e4ss".encode()))],
                                  "file_name string, content binary")
    assert [r.file_name for r in decode_utf8(frame).collect()] == ["b"]


def test_added_lines(spark):
    frame = spark.createDataFrame([("f", "--- a\n+++ b\n@@ -1 +1,2 @@\n+one\n context\n-gone\n++two\n+")], "file_name string, diff string")
    assert [(r.line_number, r.line) for r in added_lines(frame).collect()] == [(1, "one"), (2, "+two"), (3, "")]


def test_pull_request_documents(spark, tmp_path):
    (tmp_path / "pr.json").write_text(
        '{"repo_url": "https://h/o/r", "pr_number": 8, "sha": "s1", "files": [{"filename": "a", "patch": "@@ -0,0 +1 @@\\n+pwd"},'
        ' {"filename": "empty"}]}\n{"repo_url": "https://h/o/r", "pr_number": 8, "sha": "s2", "files": []}\n')
    rows = pull_request_patches(read_pull_requests(spark, str(tmp_path))).collect()
    assert [(r.commit_id, r.file_name) for r in rows] == [("s1", "a")]
    assert scan_patches(pull_request_patches(read_pull_requests(spark, str(tmp_path))), DEFAULT_RULES).select(
        F.max("line_number")).first()[0] == 1
