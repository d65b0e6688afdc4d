"""Scanning each content once equals scanning every file."""

from pyspark.sql import functions as F

from keysieve.operators.contents import ContentStore
from keysieve.operators.lines import file_lines
from keysieve.operators.matching import match_lines
from keysieve.plans import corpus

COLUMNS = ["repo_url", "commit_id", "file_name", "line_number", "snippet", "rule_id"]


def plain(files):
    rules = corpus.CORPUS_RULES
    return sorted(map(tuple, match_lines(file_lines(files, rules=rules), rules).select(*COLUMNS).collect()), key=str)


def test_scan_by_content_equals_a_scan_of_every_file(spark, tmp_path):
    texts = ["a@b.org\r\nplain\n(017) 555-7713", "", None, "1.2.3.4", "1.2.3.4\n", "nothing", "mail x@y.net é\n" * 3]
    rows = [(f"r{i % 5}", f"c{i}", "f.py", texts[i % 7] if i % 3 else texts[6]) for i in range(120)]
    schema = "repo_url string, commit_id string, file_name string, content string"
    files = spark.createDataFrame(rows + rows[:4] + [(None, None, None, texts[0])], schema)
    store = ContentStore(spark, str(tmp_path / "store"))
    assert store.contents().isEmpty() and store.scan(files, corpus.CORPUS_RULES).isEmpty()
    early = files.filter("commit_id < 'c5'")
    assert store.add(early).count() == 6
    assert store.add(files).count() == 0 and store.contents().count() == 6
    got = sorted(map(tuple, store.scan(files, corpus.CORPUS_RULES).select(*COLUMNS).collect()), key=str)
    assert got == plain(files) and len(got) > 200
    assert store.contents().select(F.sum(F.length("content"))).first()[0] < 150

    later = spark.createDataFrame([("r9", "c900", "n.py", "new@mail.org"), ("r9", "c900", "o.py", texts[3])], schema)
    added = store.add(later)
    assert [r.content for r in added.collect()] == ["new@mail.org"]
    assert store.matches(corpus.CORPUS_RULES, added).count() == 1
    assert sorted(map(tuple, store.scan(later, corpus.CORPUS_RULES).select(*COLUMNS).collect()), key=str) == plain(later)


def test_a_failed_addition_adds_nothing(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([("r", "c", "f", "a@b.org")], "repo_url string, commit_id string, file_name string, content string")
    broken = files.withColumn("content", F.raise_error(F.lit("lost")).cast("string"))
    try:
        store.add(broken)
    except Exception as error:
        assert "lost" in str(error)
    assert ContentStore(spark, store.path).contents().isEmpty()
    store.add(files)
    assert store.contents().count() == 1
