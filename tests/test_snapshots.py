"""Line differences against brute force, and differences of snapshots."""

import random
import re

import pytest

from keysieve import DEFAULT_RULES
from keysieve.operators.line_diff import equal_lines, hunks, patched, split_lines
from keysieve.plans import scans
from keysieve.sources import snapshots

KEYS = "repo_url string, commit_id string, file_name string, content string"


def common(a, b):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefghij"])
def test_random_texts(letters):
    rng = random.Random(len(letters))
    for _ in range(400):
        old, new = ("\n".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) + rng.choice(["", "\n"]) for _ in range(2))
        a, b = split_lines(old)[0], split_lines(new)[0]
        pairs = equal_lines(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        assert patched(old, hunks(a, b), split_lines(new)[1]) == new
        if not set(x for x in a if a.count(x) == 1) & set(x for x in b if b.count(x) == 1):
            assert len(pairs) == common(a, b)     # without anchors the edit path is a shortest one


def test_what_is_kept_is_found_whole():
    """If the new text is the old one with lines left out and others put in, no old line counts as added."""
    rng = random.Random(6)
    for _ in range(300):
        old = [rng.choice("aabbc{}") for _ in range(rng.randint(0, 60))]
        new = []
        for line in old:
            new += [line] * (rng.random() < 0.7) + [f"new {len(new)} {rng.random()}"] * (rng.random() < 0.2)
        assert [x for h in hunks(old, new) for x in h["added"]] == [x for x in new if x.startswith("new ")]


def test_moved_blocks_repeats_and_empty_texts():
    block, rest = [f"m{i}" for i in range(5)], [f"r{i}" for i in range(20)]
    assert [h["added"] for h in hunks(block + rest, rest + block)] == [[], block]
    assert hunks(["}"] * 5000, ["}"] * 5001) == [{"old_from": 5000, "removed": [], "new_from": 5000, "added": ["}"]}]
    assert hunks([], []) == [] and hunks([], ["a"]) == [{"old_from": 0, "removed": [], "new_from": 0, "added": ["a"]}]
    assert hunks(["a", " b"], ["a", "b "], ignore_space=True) == [] and len(hunks(["a", " b"], ["a", "b "])) == 1
    assert split_lines("") == ([], False) and split_lines("\n") == ([""], True) and split_lines(None) == ([], False)


def test_long_texts():
    rng = random.Random(2)
    old = [rng.choice(["", "}", "{", f"x{rng.randint(0, 9999)}"]) for _ in range(60_000)]
    new = [x for x in old if rng.random() > 0.01]
    new[30_000:30_000] = ["put in"]
    assert [x for h in hunks(old, new) for x in h["added"]] == ["put in"]


def applied(old, patch):
    """A patch without context put into a text, as a reader of patches would do it."""
    lines, out, at = split_lines(old)[0], [], 0
    for row in patch.split("\n") if patch else []:
        header = re.fullmatch(r"@@ -(\d+),(\d+) \+(\d+),(\d+) @@", row)
        if header:
            start = int(header[1]) - (header[2] != "0")
            out += lines[at:start]
            at = start
        elif row[0] == "-":
            assert lines[at] == row[1:]
            at += 1
        else:
            out.append(row[1:])
    return out + lines[at:]


def test_patches_of_snapshots(spark):
    rng = random.Random(9)
    text = lambda: "\n".join(rng.choice(["a", "b", "", f"u{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 25)))
    old = {f"f{i}": text() for i in range(30)} | {"same": "x\ny", "gone": "z", "empty": ""}
    new = {f"f{i}": text() for i in range(30)} | {"same": "x\ny", "fresh": "q\n", "empty": "now\n"}
    rows = [("r", "1", n, t) for n, t in old.items()] + [("r", "2", n, t) for n, t in new.items()] + [("other", "2", "f0", "no")]
    pairs = spark.createDataFrame([("r", "1", "2"), ("r", "2", "2"), ("r", "7", "8")], "repo_url string, commit_from string, commit_id string")
    diff = snapshots.snapshot_diff(spark.createDataFrame(rows, KEYS), pairs)
    got = {r["file_name"]: r for r in diff.collect()}
    assert set(got) == {n for n in old.keys() | new.keys() if old.get(n) != new.get(n)}
    assert [got[n]["change_type"] for n in ("gone", "fresh", "empty")] == ["D", "A", "M"]
    for name, row in got.items():
        assert patched(old.get(name), [h.asDict() for h in row["hunks"]], row["newline"]) == new.get(name, "")
    for row in snapshots.diff_patches(diff).collect():
        name = row["b_path"] or row["a_path"]
        assert applied(old.get(name), row["patch"]) == split_lines(new.get(name))[0]
    lines = {(r["file_name"], r["line_number"]): r["line"] for r in snapshots.added_lines(diff).collect()}
    assert all(split_lines(new[f])[0][n - 1] == line for (f, n), line in lines.items()) and lines["fresh", 1] == "q"
    nothing = spark.createDataFrame([], KEYS)
    assert snapshots.snapshot_diff(nothing, pairs).isEmpty()


def test_scan_of_a_difference(spark):
    rows = [("r", "1", "a.py", "pwd 1\nx\n"), ("r", "2", "a.py", "  pwd 1\nx\npwd 2\n" + "pwd" * 200 + "\n pwd 3"),
            ("r", "1", "b.py", "pwd 4"), ("r", "2", "c.py", "pwd 5"), ("r", "2", "skip/d.py", "pwd 6")]
    pairs = spark.createDataFrame([("r", "1", "2")], "repo_url string, commit_from string, commit_id string")
    files = spark.createDataFrame(rows, KEYS)
    found = scans.scan_snapshot_diff(files, pairs, DEFAULT_RULES, ignore_list=["skip"]).collect()
    assert sorted((r.file_name, r.line_number, r.snippet) for r in found) == [
        ("a.py", 3, "pwd 2"), ("a.py", 5, "pwd 3"), ("c.py", 1, "pwd 5")]
    spaced = scans.scan_snapshot_diff(files, pairs, DEFAULT_RULES, ignore_space=False).collect()
    assert sorted((r.file_name, r.line_number) for r in spaced) == [("a.py", 1), ("a.py", 3), ("a.py", 5), ("c.py", 1), ("skip/d.py", 1)]
