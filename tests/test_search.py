"""Substring search by trigrams equals a scan."""

import random

import pyarrow as pa
import pytest

from keysieve.operators.search import SearchIndex, _gram_rows, _gram_texts, _postings


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["tion", "the", "éa", "x", "aaa", "aa", "𝒳y", "Key", "key", "", "%", "_", "\\", "\n"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 9)))) for i in range(3000)]
    return rows + [(5000, None), (None, "the key"), (5001, ""), (5002, "z" * 50_000 + "needle"), (5003, "aaaa")]


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    rows = spark.createDataFrame(texts, "id long, text string")
    return SearchIndex.build(rows, str(tmp_path_factory.mktemp("index")), part_rows=400)


@pytest.mark.parametrize("pattern", ["key", "Key", "aaaa", "the tion", "éa𝒳", "𝒳y ", "x", "", "a", "%", "_", "\\ th", "needle", "no such", "y\n", "aa\naa"])
def test_search_equals_a_scan(index, texts, pattern):
    want = sorted(i for i, t in texts if i is not None and t is not None and pattern in t)
    assert sorted(r.id for r in index.search(pattern).collect()) == want


def test_few_rows_are_looked_at(index):
    assert index.candidates("needle").count() == 1 and index.candidates("no such").isEmpty()
    plan = index.postings().filter("gram = 'nee'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,nee)]" in plan


def test_no_rows(spark, tmp_path):
    empty = SearchIndex.build(spark.createDataFrame([], "id long, text string"), str(tmp_path / "i"))
    assert empty.search("abc").isEmpty() and empty.search("a").isEmpty()


def test_lists_of_trigrams_against_python():
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32()))], names=["id", "text", "part"])

    rng = random.Random(2)
    rows = [(i // 2, "".join(rng.choice("ab é𝒳\n") for _ in range(rng.randint(0, 9))), i // 2500) for i in range(7001)]
    want = {}
    for key, text, part in rows:
        for gram in {text[i:i + 3] for i in range(len(text) - 2)}:
            want.setdefault((part, gram), []).append(key)
    got = [r for b in _postings(batch(rows[i:i + 1100]) for i in range(0, len(rows), 1100)) for r in b.to_pylist()]
    assert [(r["part"], r["gram"]) for r in got] == sorted(want)
    assert all(r["ids"] == want[r["part"], r["gram"]] and r["n"] == len(r["ids"]) for r in got)
    assert not list(_postings(iter([]))) and not list(_postings(iter([batch([(1, "ab", 0), (2, "", 1)])])))


def test_lists_are_made_for_blocks_of_rows():
    grams, rows = _gram_rows(["abcabc", "ab", "", "xabc"], 10)
    assert _gram_texts(grams) == ["abc", "abc", "bca", "cab", "xab"] and rows.tolist() == [10, 13, 10, 10, 13]
