"""Trees, globs, commit chains and skew helpers."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from keysieve import DEFAULT_RULES, scan_path
from keysieve.functions import paths
from keysieve.operators.skew import dense_positions, is_small, lookup_join, salted_join, with_parts
from keysieve.sources import commits as C
from keysieve.sources.files import read_tree


@pytest.fixture
def tree(tmp_path):
    contents = {
        "file_a.py": b"import os\npassword = 'x'\n# nothing\npwd = 1\nsshpass\n", "file_b.txt": b"a\nb\npasswd\n",
        "scan_tests/scan_a.py": b"a\npassword\nb\npwd\n", "scan_tests/subdir/scan_b.txt": b"pwd without newline",
        "subdir_A/file_Aa.yml": b"x\ny\npassword: z\n", "subdir_A/subdir_AB/file_ABa.txt": b"nothing\n",
        "file_c.png": b"\x89PNG password \xff\n"}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def names(frame):
    return sorted({r.file_name for r in frame.select("file_name").collect()})


def test_scan_tree(spark, tree):
    rows = scan_path(spark, str(tree), DEFAULT_RULES).collect()
    found = sorted((r.file_name, r.line_number) for r in rows)
    assert found == [("file_a.py", 2), ("file_a.py", 4), ("file_a.py", 5), ("file_b.txt", 3),
                     ("scan_tests/scan_a.py", 2), ("scan_tests/scan_a.py", 4), ("scan_tests/subdir/scan_b.txt", 1),
                     ("subdir_A/file_Aa.yml", 3)]
    assert scan_path(spark, str(tree / "scan_tests"), DEFAULT_RULES).count() == 3
    one = scan_path(spark, str(tree / "file_a.py"), DEFAULT_RULES).collect()
    assert sorted(r.line_number for r in one) == [2, 4, 5] and {r.file_name for r in one} == {"file_a.py"}
    assert scan_path(spark, str(tree / "file_c.png"), DEFAULT_RULES).count() == 0


@pytest.mark.parametrize("path", ["/nonexistentdirectory/", "not?a,path"])
def test_missing_path(spark, path):
    with pytest.raises(FileNotFoundError):
        read_tree(spark, path)


@pytest.mark.parametrize("options, gone", [
    ({"max_depth": 0}, ["scan_tests/scan_a.py", "scan_tests/subdir/scan_b.txt", "subdir_A/file_Aa.yml", "subdir_A/subdir_AB/file_ABa.txt"]),
    ({"max_depth": 1}, ["scan_tests/subdir/scan_b.txt", "subdir_A/subdir_AB/file_ABa.txt"]),
    ({"max_depth": 2}, []), ({"max_depth": -1}, []),
    ({"ignore_list": ["subdir_A", "file_b.txt"]}, ["file_b.txt", "subdir_A/file_Aa.yml", "subdir_A/subdir_AB/file_ABa.txt"]),
    ({"ignore_list": ["*_A*"]}, ["subdir_A/file_Aa.yml", "subdir_A/subdir_AB/file_ABa.txt"]),
    ({"ignore_list": ["*.txt"]}, ["file_b.txt", "scan_tests/subdir/scan_b.txt", "subdir_A/subdir_AB/file_ABa.txt"]),
    ({"ignore_list": ["nonexistent_file.txt", "*z*"]}, []),
])
def test_prune(spark, tree, options, gone):
    everything = names(read_tree(spark, str(tree)))
    assert names(read_tree(spark, str(tree), **options)) == [n for n in everything if n not in gone]


def test_globs_agree_with_fnmatch(spark):
    rng = random.Random(5)
    globs = ["*.py", "a?c", "[ab]*", "[!a]*", "*[.]md", "a[", "x/y*", "*&&*", "[a&&b]c", "a.b", "(x)|y", "[]a]b", "*\\d", "$^", "[a-c]x"]
    parts = ["a", "b", "c", ".py", ".md", "/", "x", "y", "&&", "(", ")|", "\\d", "[", "]", "d", "$^", "ac", "b/x"]
    texts = sorted({"".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(400)})
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for glob in globs:
        hit = F.col("t").rlike(rf"(?s)\A(?:{paths.glob_pattern(glob)})\z")
        got = {r.t for r in frame.filter(hit).collect()}
        assert got == {t for t in texts if fnmatch.fnmatchcase(t, glob)}, glob


def test_path_model(spark):
    flagged = ["a/test/x.py", "Contest.c", "README.md", "x.CSS", "node_modules/a", "Makefile", "a.rst", "example"]
    kept = ["demo.py", "src/a.py", "css.py", "md"]
    frame = spark.createDataFrame([(p,) for p in flagged + kept], "p string")
    rows = frame.filter(paths.is_false_positive_path(F.col("p"))).collect()
    assert sorted(r.p for r in rows) == sorted(flagged)


def chain(spark, branches):
    rows = [("r", b, i, c, d) for b, commits in branches.items() for i, (c, d) in enumerate(commits)]
    return spark.createDataFrame(rows, "repo_url string, branch string, pos bigint, commit_id string, committed_date bigint")


def test_parents_across_blocks(spark):
    commits = chain(spark, {"main": [(f"m{i}", 100 - i) for i in range(23)], "dev": [("d0", 5)]})
    rows = C.commit_chain(commits, block=5).orderBy("branch", "pos").collect()
    assert [(r.commit_id, r.parent_id) for r in rows] == [("d0", None)] + [
        (f"m{i}", f"m{i + 1}" if i < 22 else None) for i in range(23)]


def test_stop_is_not_a_filter_and_pairs_are_unique(spark):
    commits = chain(spark, {"b1": [("e", 50), ("d", 10), ("c", 40), ("a", 1)], "b2": [("x", 60), ("c", 40), ("a", 1)]})
    pairs = C.commit_pairs(commits)
    kept = C.commits_since(pairs, 10).collect()
    assert sorted((r.branch, r.commit_id) for r in kept) == [("b1", "e"), ("b2", "c"), ("b2", "x")]
    assert sorted(C.pairs_since(commits, 10).collect()) == sorted(kept)
    unique = C.unique_pairs(pairs).collect()
    assert sorted((r.branch, r.commit_id, r.parent_id) for r in unique) == [
        ("b1", "c", "a"), ("b1", "d", "c"), ("b1", "e", "d"), ("b2", "x", "c")]
    assert [r.commit_id for r in C.root_commits(commits).collect()] == ["a"]


def test_resolve_refs(spark):
    refs = spark.createDataFrame([("r", "refs/remotes/origin/main", "c2"), ("r", "refs/heads/main", "c1"),
                                  ("r", "refs/heads/feature/x", "c3")], "repo_url string, ref_name string, commit_id string")
    asked = spark.createDataFrame([("r", n) for n in ("main", "x", "feature/x", "abc", "ain")], "repo_url string, name string")
    got = {r.name: r.commit_id for r in C.resolve_refs(asked, refs).collect()}
    assert got == {"main": "c1", "x": "c3", "feature/x": "c3", "abc": "abc", "ain": "ain"}


def test_dense_positions_on_a_hot_key(spark):
    rows = [("hot", i * 3) for i in range(500)] + [("b", 7), ("c", 9)]
    frame = spark.createDataFrame(rows, "k string, o bigint")
    got = dense_positions(frame, ["k"], "o", block=100).filter("k = 'hot'").orderBy("pos").collect()
    assert [(r.pos, r.o) for r in got] == [(i, (499 - i) * 3) for i in range(500)]


def test_salted_join_and_parts_keep_every_row(spark):
    large = spark.createDataFrame([("hot", i) for i in range(300)] + [(None, -1), ("b", 1)], "k string, id int")
    small = spark.createDataFrame([("hot", "x"), ("b", "y"), ("z", "q")], "k string, v string")
    assert salted_join(large, small, ["k"], F.col("id"), 7).count() == 301
    assert salted_join(large, small, ["k"], F.col("id"), 7, "left").count() == 302
    parts = with_parts(large, ["k"], "id", 50).groupBy("k", "part").count().collect()
    assert sum(r["count"] for r in parts) == 302
    assert len([r for r in parts if r.k == "hot"]) == 6
    assert [r.part for r in parts if r.k is None or r.k == "b"] == [0, 0]


def test_lookup_join_checks_the_size(spark, monkeypatch):
    large = spark.createDataFrame([(1, i) for i in range(50)] + [(9, 99)], "k int, id int")
    small = spark.createDataFrame([(i, "v") for i in range(5)], "k int, v string")
    assert is_small(small) and not is_small(small, rows=4) and not is_small(small, characters=10)
    expected = sorted(lookup_join(large, small, "k", F.col("id")).collect(), key=str)
    monkeypatch.setattr("keysieve.operators.skew.is_small", lambda frame: False)
    assert sorted(lookup_join(large, small, "k", F.col("id")).select("k", "id", "v").collect(), key=str) == expected
