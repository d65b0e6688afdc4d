"""File trees: every file is seen, and a file cut into pieces reads as a whole."""

import os
import random

import pytest

from keysieve import DEFAULT_RULES, scan_path
from keysieve.sources import trees
from keysieve.sources.files import read_tree


@pytest.fixture
def tree(tmp_path):
    for name, body in {".env": "pwd 1", "_x/.git/config": "a\npwd 2\n", "src/a b.py": "pwd 3\r\nx\rpwd 4", "empty": "",
                       "deep/1/2/3/é.txt": "pwd 5\n", "tests/t.py": "pwd 6", "src/tests/t.py": "pwd 7"}.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body.encode())
    (tmp_path / "root" / "bin.dat").write_bytes(b"pwd\n\xff\xfe" + b"pwd\n" * 100)
    os.symlink(tmp_path / "root", tmp_path / "root" / "deep" / "circle")
    return tmp_path / "root"


def found(frame):
    return sorted((r.file_name, r.line_number, r.snippet) for r in frame.collect())


EXPECTED = [(".env", 1, "pwd 1"), ("_x/.git/config", 2, "pwd 2"), ("deep/1/2/3/é.txt", 1, "pwd 5"), ("src/a b.py", 1, "pwd 3"),
            ("src/a b.py", 3, "pwd 4"), ("src/tests/t.py", 1, "pwd 7"), ("tests/t.py", 1, "pwd 6")]


@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_every_file(spark, tree, piece):
    assert found(scan_path(spark, str(tree), DEFAULT_RULES, piece_bytes=piece)) == EXPECTED


def test_pruning_depth_links_and_frontier(spark, tree):
    listed = lambda **o: {r.file_name for r in trees.list_tree(spark, str(tree), **o).collect()}
    everything = {n for n, _, _ in EXPECTED} | {"empty", "bin.dat"}
    for folders in (1, 2, 4, 256):
        assert listed(folders=folders) == everything
    assert listed(max_depth=0) == {".env", "empty", "bin.dat"}
    assert listed(ignore_list=["tests", "*.git", "deep/1/*"]) == everything - {"tests/t.py", "_x/.git/config", "deep/1/2/3/é.txt"}
    assert found(scan_path(spark, str(tree), DEFAULT_RULES, ignore_list=["src"])) == [e for e in EXPECTED if not e[0].startswith("src/")]


def test_relative_roots_uris_and_single_files(spark, tree, monkeypatch):
    monkeypatch.chdir(tree.parent)
    assert found(scan_path(spark, "root", DEFAULT_RULES)) == EXPECTED
    assert found(scan_path(spark, "./root/../root/", DEFAULT_RULES)) == EXPECTED
    for uri in (f"file://{tree}", f"file:{tree}"):
        assert found(scan_path(spark, uri, DEFAULT_RULES)) == EXPECTED
    assert found(scan_path(spark, "root/.env", DEFAULT_RULES)) == [(".env", 1, "pwd 1")]
    assert {r.file_name: bytes(r.content) for r in read_tree(spark, "root").collect()}["empty"] == b""
    with pytest.raises(FileNotFoundError):
        scan_path(spark, "missing", DEFAULT_RULES)
    assert not trees.can_open("viewfs://store/x")


def test_a_file_in_fifty_pieces(spark, tmp_path):
    rng = random.Random(1)
    lines = []
    for i in range(3000):
        body = rng.choice(["", "x" * rng.randint(0, 200), f"pwd {i}", "é" * rng.randint(0, 9), "pwd" + "y" * 3000])
        lines.append(body + rng.choice(["\n", "\r\n", "\r", "\n\n"]))
    text = "".join(lines)
    (tmp_path / "big.txt").write_bytes(text.encode())
    parts = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    expected = [("big.txt", i, line) for i, line in enumerate(parts, 1) if line.startswith("pwd")]
    size = len(text.encode())
    for piece in (size // 50 + 1, 97, size):
        assert found(scan_path(spark, str(tmp_path), DEFAULT_RULES, piece_bytes=piece)) == expected
    (tmp_path / "big.txt").write_bytes(text.encode() + b"\xff")
    assert found(scan_path(spark, str(tmp_path), DEFAULT_RULES, piece_bytes=size // 50)) == []


def test_pieces_hold_every_line_once(tmp_path):
    rng = random.Random(7)
    for _ in range(200):
        data = bytes(rng.choice(b"ab\r\n") for _ in range(rng.randint(0, 40)))
        (tmp_path / "f").write_bytes(data)
        with trees.open_root(str(tmp_path / "f"))[0].open_input_file(str(tmp_path / "f")) as file:
            for step in (1, 2, 5, 100):
                whole = [trees._Bytes(file, len(data)).lines(a, min(a + step, len(data))) for a in range(0, len(data), step)]
                assert b"".join(whole) == data
                assert sum(len(w.splitlines()) for w in whole) == len(data.splitlines())
