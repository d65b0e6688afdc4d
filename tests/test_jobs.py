"""Scan jobs end to end, through the workspace and as streams."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from keysieve import DEFAULT_RULES, Workspace, scan_history, scan_patches
from keysieve.operators import models
from keysieve.schemas import COMMITS, PATCHES, REFS
from keysieve.streaming import jobs

URL = "https://h/o/r"


def patch(line):
    return f"@@ -0,0 +1,2 @@\n+first\n+{line}"


@pytest.fixture
def history(spark):
    """main: c3 -> c2 -> c1, dev: c4 -> c2 -> c1."""
    commits = spark.createDataFrame(
        [(URL, "main", 0, "c3", 300), (URL, "main", 1, "c2", 200), (URL, "main", 2, "c1", 100),
         (URL, "dev", 0, "c4", 400), (URL, "dev", 1, "c2", 200), (URL, "dev", 2, "c1", 100)], COMMITS)
    rows = [("c1", None, 100, "A", patch("password root")), ("c2", "c1", 200, "M", patch("password two")),
            ("c3", "c2", 300, "A", patch("password three")), ("c4", "c2", 400, "D", patch("password deleted")),
            ("c4", "c2", 400, "A", patch("password four")), ("c4", "c3", 400, "A", patch("password other pair")),
            ("c3", "c2", 300, "M", "Binary files a and b differ password")]
    patches = spark.createDataFrame([(URL, c, p, d, t, None, f"{i}.py", x) for i, (c, p, d, t, x) in enumerate(rows)], PATCHES)
    return patches, commits


def snippets(frame):
    return sorted(r.snippet.removeprefix("password ") for r in frame.collect())


def test_history(spark, history):
    patches, commits = history
    assert snippets(scan_history(patches, commits, DEFAULT_RULES)) == ["four", "root", "three", "two"]
    assert snippets(scan_history(patches, commits, DEFAULT_RULES, since=200)) == ["four", "three"]
    assert snippets(scan_history(patches, commits, DEFAULT_RULES, since=1000)) == []
    assert snippets(scan_history(patches, commits, DEFAULT_RULES, max_depth=2)) == ["four", "three"]
    repos = spark.createDataFrame([(URL, 200), ("x", None)], "url string, last_scan bigint")
    assert snippets(scan_history(patches, commits, DEFAULT_RULES, since=repos)) == ["four", "three"]
    again = scan_history(patches, commits, DEFAULT_RULES)
    assert {r.id for r in again.collect()} == {r.id for r in scan_history(patches, commits, DEFAULT_RULES).collect()}


@pytest.fixture
def workspace(spark, tmp_path):
    store = Workspace(spark, str(tmp_path / "store"))
    store.add_rules([rule._asdict() for rule in DEFAULT_RULES])
    return store


def test_workspace_history(spark, history, workspace):
    patches, commits = history
    early = commits.filter("branch = 'main' and pos > 0").withColumn("pos", F.col("pos") - 1)
    left = workspace.scan(patches, early, models=["path"], similarity=True)
    assert snippets(left) == ["root", "two"]
    assert workspace.get_embeddings(URL).count() == 2
    assert workspace.get_repos().first().last_scan > 1_000_000_000
    # Everything is older than the scan, so a second scan adds nothing.
    assert workspace.scan(patches, commits).isEmpty()
    assert workspace.update_discovery_group("fixed", URL) and not workspace.update_discovery_group("odd", URL)
    assert {r.state for r in workspace.get_discoveries(URL).collect()} == {"fixed"}
    assert snippets(workspace.scan(patches, commits, force=True)) == ["four", "root", "three", "two"]
    assert {r.state for r in workspace.get_discoveries(URL).collect()} == {"new"}
    assert workspace.get_embeddings(URL).isEmpty()
    first = workspace.get_discoveries().orderBy("id").first()
    assert workspace.update_discovery(first.id, "addressing")
    assert workspace.get_discovery(first.id).first().state == "addressing"
    assert workspace.update_similar_snippets(first.snippet, "fixed", URL, compute_missing_embeddings=True, threshold=-1) == 4
    assert workspace.get_discoveries_count(URL, state="fixed") == 4
    workspace.delete_rule(9)
    assert {r.rule_id for r in workspace.get_discoveries().collect()} == {None} and workspace.get_rule(9) is None
    assert len(workspace.get_discoveries(URL, with_rules=True).columns) == 12
    assert workspace.get_page(URL, 10).count() == 4
    assert workspace.get_overview([URL]).first().fixed == 4
    workspace.delete_repo(URL)
    assert workspace.get_repos().isEmpty() and workspace.get_discoveries().isEmpty() and workspace.get_embeddings().isEmpty()


def test_workspace_path(spark, workspace, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("pwd\nx\npwd 2\n")
    path = str(tmp_path / "src")
    assert workspace.scan_path(path).count() == 2
    with pytest.raises(ValueError):
        workspace.scan_path(path)
    (tmp_path / "src" / "a.py").write_text("pwd\n")
    assert workspace.scan_path(path, force=True).count() == 1 and workspace.get_discoveries(path).count() == 1
    with pytest.raises(FileNotFoundError):
        workspace.scan_path(str(tmp_path / "missing"))
    with pytest.raises(ValueError):
        workspace.scan_path(str(tmp_path), category="no such category")


def test_failed_scans_leave_no_trace(spark, history, workspace):
    patches, commits = history

    def broken(frame, source, target):
        return frame.withColumn(target, F.raise_error(F.lit("model failed")).cast("boolean"))
    models.register_model("broken", models.Model(broken))
    with pytest.raises(Exception, match="model failed"):
        workspace.scan(patches, commits, models=["broken"])
    assert workspace.get_repos().isEmpty() and workspace.get_discoveries().isEmpty()
    workspace.scan(patches, commits)
    before = workspace.get_repos().first()
    with pytest.raises(Exception, match="model failed"):
        workspace.scan(patches, commits, models=["broken"], force=True)
    assert workspace.get_repos().first() == before and workspace.get_discoveries().count() == 4


def test_workspace_snapshot_and_pull_request(spark, history, workspace):
    patches, commits = history
    refs = spark.createDataFrame([(URL, "refs/heads/main", "c3")], REFS)
    files = spark.createDataFrame([(URL, "c2", "a.py", "pwd 1\n"), (URL, "c3", "a.py", "pwd 1\npwd 2\n"), (URL, "c3", "b.md", "pwd 3")],
                                  "repo_url string, commit_id string, file_name string, content string")
    ask = lambda name: spark.createDataFrame([(URL, name)], "repo_url string, name string")
    assert workspace.scan_snapshot(files, refs, commits, ask("c2")).count() == 1
    assert workspace.get_repos().first().last_scan == 200
    assert snippets(workspace.scan_snapshot(files, refs, commits, ask("main"), patches=patches)) == ["three"]
    assert workspace.get_repos().first().last_scan == 300
    forced = workspace.scan_snapshot(files, refs, commits, ask("main"), patches=patches, force=True, ignore_list=["*.md"])
    assert forced.count() == 2 and workspace.get_discoveries(URL).count() == 2
    documents = spark.createDataFrame([(URL, 8, "s", [("a", patch("pwd"))]), (URL, 2, "t", [("a", None)])],
                                      "repo_url string, pr_number int, sha string, files array<struct<filename: string, patch: string>>")
    assert workspace.scan_pull_request(documents, URL + ".git/", 8).isEmpty()
    assert workspace.scan_pull_request(documents, URL, 8, force=True).count() == 1
    assert workspace.get_discoveries(URL).count() == 1


def test_workspace_user_and_wiki(spark, history, workspace):
    patches, commits = history
    meta = spark.createDataFrame([(URL, "o", False), ("https://h/o/fork", "o", True)], "url string, owner string, fork boolean")
    forked = [f.unionByName(f.withColumn("repo_url", F.lit("https://h/o/fork"))) for f in (patches, commits)]
    assert workspace.scan_user(*forked, meta, "o").count() == 4
    assert workspace.scan_user(*forked, meta, "o", forks=True, force=True).count() == 8
    wiki = [f.withColumn("repo_url", F.lit(URL + ".wiki.git")) for f in (patches, commits)]
    for _ in range(2):
        assert workspace.scan_wiki(*wiki, spark.createDataFrame([(URL,)], "url string")).count() == 4
    assert workspace.get_discoveries(URL + ".wiki.git").count() == 4


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = [(URL, f"c{i}", "f", patch(f"password {i}") if i % 3 else patch("nothing")) for i in range(30)]
    frame = spark.createDataFrame(rows, jobs.ARRIVING)
    landed, target, progress = (str(tmp_path / n) for n in ("landed", "target", "progress"))
    frame.filter("commit_id < 'c2'").write.parquet(landed)
    jobs.scan_patch_stream(spark, landed, target, progress, DEFAULT_RULES)
    frame.filter("commit_id >= 'c2'").write.mode("append").parquet(landed)
    jobs.scan_patch_stream(spark, landed, target, progress, DEFAULT_RULES)
    batch = scan_patches(frame, DEFAULT_RULES)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == sorted(r.id for r in batch.collect())


def test_keyed_state_of_a_stream(spark, tmp_path):
    at = lambda day: datetime(2024, 1, day)
    runs = [[(URL, f"c{i}", "p", at(20)) for i in range(40)] + [(URL, "c1", "p", at(21)), (URL, "root", None, at(20)), ("other", None, None, at(9))],
            [],
            [(URL, "c1", "p", at(2)), (URL, "root", None, at(2)), (URL, "late", "p", at(1)), ("other", None, None, at(10)), (None, "c", "p", None)]]
    landed, store, progress = (str(tmp_path / n) for n in ("landed", "store", "progress"))
    for rows in [*runs, runs[0]]:
        spark.createDataFrame(rows, jobs.PAIRS).write.mode("append").parquet(landed)
        jobs.pair_state_stream(spark, landed, store, progress, files=1)
    got = [tuple(r)[:3] for r in jobs.stored_pairs(spark, store).collect()]
    assert len(got) == len(set(got)) and set(got) == {r[:3] for rows in runs for r in rows}
    last = {r["url"]: r["last_scan"] for r in jobs.stored_scan_times(spark, store).collect()}
    seconds = lambda t: int(t.replace(tzinfo=timezone.utc).timestamp())
    assert last == {URL: seconds(at(21)), "other": seconds(at(10)), None: None}
    assert spark.conf.get(jobs.STATE_STORE) != jobs.ON_DISK


def test_keyed_state_forgets_after_a_time(spark, tmp_path):
    at = lambda day: datetime(2024, 1, day)
    landed, store, progress = (str(tmp_path / n) for n in ("landed", "store", "progress"))
    for rows in ([(URL, "a", "p", at(1)), (URL, "a", "p", at(2))], [(URL, "b", "p", at(20))], [(URL, "a", "p", at(21)), (URL, "b", "p", at(21))]):
        spark.createDataFrame(rows, jobs.PAIRS).coalesce(1).write.mode("append").parquet(landed)
        jobs.pair_state_stream(spark, landed, store, progress, forget="5 days")
    assert sorted(r["commit_id"] for r in jobs.stored_pairs(spark, store).collect()) == ["a", "a", "b"]


def test_replayed_batch_is_stored_once(spark, history, tmp_path):
    found = scan_history(*history, DEFAULT_RULES)
    store = str(tmp_path / "store")
    for _ in range(2):
        jobs.store_batch(found, 0, store)
    jobs.store_batch(found.limit(0), 1, store)
    assert jobs.stored_discoveries(spark, store).count() == 4
    assert jobs.stored_scan_times(spark, store).count() == 1


def test_discoveries_of_two_parents_have_their_own_ids(spark, history):
    patches, commits = history
    other = spark.createDataFrame([(URL, "alt", 0, "c4", 400), (URL, "alt", 1, "c3", 300)], COMMITS)
    same = patches.filter("commit_id = 'c4' and change_type = 'A'").withColumn("b_path", F.lit("same.py"))
    rows = scan_history(same, commits.unionByName(other), DEFAULT_RULES).collect()
    assert len(rows) == 2 and len({r.id for r in rows}) == 2


def test_snapshot_without_a_landed_delta_is_scanned_whole(spark, history, workspace):
    patches, commits = history
    refs = spark.createDataFrame([(URL, "refs/heads/main", "c3")], REFS)
    files = spark.createDataFrame([(URL, "c1", "a.py", "pwd 1\n"), (URL, "c3", "a.py", "pwd 1\npwd 2\n")],
                                  "repo_url string, commit_id string, file_name string, content string")
    ask = lambda name: spark.createDataFrame([(URL, name)], "repo_url string, name string")
    with pytest.raises(ValueError, match="no-such-branch"):
        workspace.scan_snapshot(files, refs, commits, ask("no-such-branch"))
    assert workspace.get_repos().isEmpty()
    assert workspace.scan_snapshot(files, refs, commits, ask("c1")).count() == 1
    # Patches lead from c1 to c2 and from c2 to c3, none from c1 to c3.
    alone = files.filter("commit_id = 'c3'")
    assert workspace.scan_snapshot(alone, refs, commits, ask("main"), patches=patches).count() == 2
    assert workspace.scan_snapshot(alone, refs, commits, ask("main"), patches=patches).isEmpty()


@pytest.mark.parametrize("with_patches", [True, False])
def test_snapshot_is_compared_with_the_files_of_the_last_scan(spark, history, workspace, with_patches):
    patches, commits = history
    refs = spark.createDataFrame([(URL, "refs/heads/main", "c3")], REFS)
    files = spark.createDataFrame([(URL, "c1", "a.py", "pwd 1\n"), (URL, "c3", "a.py", "x\npwd 1\npwd 2\n"), (URL, "c3", "skip.md", "pwd 3")],
                                  "repo_url string, commit_id string, file_name string, content string")
    ask = lambda name: spark.createDataFrame([(URL, name)], "repo_url string, name string")
    given = patches if with_patches else None
    assert workspace.scan_snapshot(files, refs, commits, ask("c1"), patches=given).count() == 1
    found = workspace.scan_snapshot(files, refs, commits, ask("main"), patches=given, ignore_list=["*.md"]).collect()
    assert [(r.line_number, r.snippet, r.commit_id) for r in found] == [(3, "pwd 2", "c3")]
    assert workspace.scan_snapshot(files, refs, commits, ask("main"), patches=given).isEmpty()
    assert workspace.get_discoveries_count(URL) == 2 and workspace.get_repos().first().last_scan == 300


def test_forced_scans_replace_only_their_repositories(spark, history, workspace, monkeypatch):
    patches, commits = history
    other = [f.withColumn("repo_url", F.lit("https://h/o/other")) for f in history]
    workspace.scan(*other, similarity=True)
    workspace.scan(patches, commits, similarity=True)
    workspace.update_discovery_group("fixed", "https://h/o/other")
    workspace.update_discovery_group("fixed", URL)
    states = lambda url: [r.state for r in workspace.get_discoveries(url).collect()]
    before = workspace.get_repos().collect()

    def failing(*args):
        raise RuntimeError("no log")
    with monkeypatch.context() as patched:
        patched.setattr(workspace.store, "commit", failing)
        with pytest.raises(RuntimeError):
            workspace.scan(patches, commits, force=True)
    assert workspace.get_repos().collect() == before and states(URL) == ["fixed"] * 4
    assert workspace.scan(patches, commits, force=True).count() == 4 and states(URL) == ["new"] * 4
    # Nothing is found any more: the repository's bucket is emptied, the other one stays.
    assert workspace.scan(patches.limit(0), commits, force=True).isEmpty()
    assert states(URL) == [] and states("https://h/o/other") == ["fixed"] * 4
    assert workspace.get_embeddings("https://h/o/other").count() == 4 and workspace.get_embeddings(URL).isEmpty()
