"""The store: changes that rewrite nothing, and jobs that fail between any two writes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from keysieve import Workspace
from keysieve.operators.store import fold_states
from keysieve.schemas import DISCOVERIES
from keysieve.sources import rules as R

URLS = ["u/a", "u/b"]


@pytest.fixture
def found(spark):
    rows = [(i, "f", "c", i, f"s{i % 2}", URLS[i % 2], 1 + i % 2, "new", None) for i in range(6)]
    return spark.createDataFrame(rows, DISCOVERIES)


@pytest.fixture
def store(spark, tmp_path, found):
    ws = Workspace(spark, str(tmp_path / "store"))
    ws.add_rules([{"regex": "a", "category": "token"}, {"regex": "b", "category": "other"}])
    ws.store_scan(found, spark.createDataFrame([(u, 1) for u in URLS], "url string, last_scan long"), similar=True)
    return ws


def picture(ws):
    counted = sorted(tuple(r) for r in ws.get_discoveries().groupBy("repo_url", "file_name", "state").count().collect())
    assert sorted(tuple(r) for r in ws.get_state_counts().collect()) == counted      # kept up to date by every job
    return (sorted(map(repr, ws.get_discoveries().drop("timestamp").collect())), sorted(ws.get_repos().collect()),
            sorted(r.id for r in ws.get_embeddings().select("id").collect()), ws.get_rules())


def states(ws):
    return {r.id: r.state for r in ws.get_discoveries().collect()}


def test_fold_against_brute_force(spark):
    rows = [(i, "new", i % 3) for i in range(20)] + [(None, "new", 0)]
    changes = [(i % 20, s, at) for at in range(4) for i, s in ((at * 3, "fixed"), (at * 7 + 1, "addressing"), (at, "new"), (99, "fixed"))] + [(5, "zz", 3), (None, "fixed", 9)]
    folded = fold_states(spark.createDataFrame(rows, "id long, state string, batch long"),
                         spark.createDataFrame(changes, "id long, state string, at long"))
    expected = []
    for i, state, batch in rows:
        last = max(((at, s) for c, s, at in changes if c == i and i is not None), default=(-1, state))
        expected.append((i, last[1] if last[0] > batch else state, batch))
    assert sorted(map(repr, map(tuple, folded.collect()))) == sorted(map(repr, expected))


def test_states_and_history(store):
    assert store.update_discovery(1, "fixed", by="ann") and store.update_discoveries([1, 2, 77], "addressing", by="bo")
    assert not store.update_discovery(3, "odd")
    assert store.update_discovery_group("not_relevant", "u/a", snippet="s0", by="cy")
    assert states(store) == {0: "not_relevant", 1: "addressing", 2: "not_relevant", 3: "new", 4: "not_relevant", 5: "new"}
    assert [(r.state, r.by) for r in store.store.history(1).collect()] == [("fixed", "ann"), ("addressing", "bo")]
    assert store.store.open_changes() == 6          # what has the state already is no change
    before = picture(store)
    assert not store.store.compact(at_least=7) and store.store.compact(at_least=6)
    assert picture(store) == before and store.store.open_changes() == 0
    store.update_discovery(1, "new")
    assert states(store)[1] == "new"


def test_deletions_and_later_scans(spark, store, found, tmp_path):
    store.update_discovery(1, "fixed")
    store.delete_embedding(3)
    store.delete_rule(2)
    assert {r.rule_id for r in store.get_discoveries("u/b").collect()} == {None}
    assert [r.regex for r in store.add_rules([{"regex": "z", "category": "other"}])] == ["z"]
    assert {r.rule_id for r in store.get_discoveries("u/b").collect()} == {None}      # though the id is used again
    assert sorted(r.id for r in store.get_embeddings().collect()) == [0, 1, 2, 4, 5]
    store.delete_discoveries("u/a")
    store.delete_embeddings("u/b")
    assert set(states(store)) == {1, 3, 5} and {r.id for r in store.get_embeddings().collect()} == {0, 2, 4}
    added = store.add_discoveries(found.unionAll(found))
    assert sorted(r.id for r in added.collect()) == [0, 2, 4] and states(store) == {0: "new", 1: "fixed", 2: "new", 3: "new", 4: "new", 5: "new"}
    store.delete_repo("u/b")
    assert [r.url for r in store.get_repos().collect()] == ["u/a"] and store.get_repo("u/b").isEmpty()
    one = spark.createDataFrame([("u/b", 9)], "url string, last_scan long")
    store.store_scan(found.filter("repo_url = 'u/b'"), one)
    assert states(store)[1] == "new" and store.get_repo("u/b").first().last_scan == 9
    before = picture(store)
    store.store.compact(0)
    assert picture(store) == before


def test_pages_keep_their_order(store):
    store.update_discovery(0, "fixed")
    rows = store.get_page("u/a", 10, order_by="state", descending=True).collect()
    assert [(r.place, r.state) for r in rows] == [(1, "new"), (2, "fixed")]
    rows = store.get_page("u/a", 1, 1, order_by="state").collect()
    assert [(r.place, r.state, len(r.occurrences)) for r in rows] == [(1, "new", 2)]


def test_rules_file(store, tmp_path):
    path = str(tmp_path / "rules.json")
    store.export_rules(path)
    assert [r[1:] for r in R.read_rules_file(path)] == [r[1:] for r in store.get_rules()]
    assert store.add_rules_from_file(path) == []


JOBS = {
    "update": lambda ws, found, one: ws.update_discoveries([0, 1, 2], "fixed"),
    "delete": lambda ws, found, one: ws.delete_repo("u/a"),
    "rule": lambda ws, found, one: ws.delete_rule(1),
    "scan": lambda ws, found, one: ws.store_scan(found.withColumn("id", F.col("id") + 3), one, similar=True),
    "forced": lambda ws, found, one: ws.store_scan(found.filter("id < 3"), one, force=True, similar=True),
    "compact": lambda ws, found, one: ws.store.compact(0),
}


@pytest.mark.parametrize("job", sorted(JOBS))
def test_a_job_that_fails_after_any_write(spark, store, found, monkeypatch, job):
    """Whichever write fails, the store is as before; the whole job makes all of its changes."""
    store.update_discovery(5, "addressing")
    before, write, one = picture(store), DataFrameWriter.parquet, spark.createDataFrame([("u/a", 7)], "url string, last_scan long")
    for allowed in range(20):
        done = 0

        def counting(self, path, *args, **options):
            nonlocal done
            if done == allowed:
                raise RuntimeError("the write fails")
            done += 1
            return write(self, path, *args, **options)
        with monkeypatch.context() as patched:
            patched.setattr(DataFrameWriter, "parquet", counting)
            try:
                JOBS[job](store, found, one)
                break
            except (RuntimeError, PySparkException):
                pass
        assert store.get_repos().count() == 2
        assert picture(store) == before
    else:
        raise AssertionError("the job never ended")
    assert (picture(store) == before) == (job == "compact")
