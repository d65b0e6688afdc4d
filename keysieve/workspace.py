"""The user-facing store: rules, repositories, discoveries and embeddings below one folder,
scan jobs that fill it and triage that changes it."""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve import schemas
from keysieve.functions import paths
from keysieve.operators import models as M
from keysieve.operators import reports, similarity, tables, triage
from keysieve.operators.store import Store
from keysieve.plans import scans
from keysieve.sources import commits as C
from keysieve.sources import rules as R
from keysieve.sources.repos import of_commits, of_repos, repos_of, wiki_repos


class Workspace:
    """``root`` is a folder every executor can reach.

    Scans work on landed sources and on all repositories in them at once. What a job stores counts from its entry in the
    store's log on, all of it together: a failed first scan leaves no repository, a failed rescan the old discoveries
    and the old scan time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = Store(spark, root)

    # rules

    def get_rules(self, category: str | None = None) -> list[R.Rule]:
        try:
            return R.scan_rules(self.store.rules(), category)
        except R.NoRulesError:
            return []

    def get_rule(self, rule_id: int) -> R.Rule | None:
        return next((rule for rule in self.get_rules() if rule.id == rule_id), None)

    def rules(self) -> DataFrame:
        return R.rules_frame(self.spark, self.get_rules())

    def _write_rules(self, rules: Iterable[R.Rule], deleted: Sequence[int] = ()) -> None:
        batch = self.store.new_batch()
        self.store.put("rules", R.rules_frame(self.spark, rules).coalesce(1), batch)
        if deleted:
            self.store.put("deleted_rules", self.spark.createDataFrame([(i,) for i in deleted], "rule_id int"), batch)
        self.store.commit(batch, ["rules", *["deleted_rules"] * bool(deleted)], ["rules"])

    def add_rules(self, entries: Iterable[dict]) -> list[R.Rule]:
        """Add rule entries; a pattern that is known already is left out."""
        stored = self.get_rules()
        known = {rule.regex for rule in stored}
        first = max((rule.id for rule in stored), default=0) + 1
        added = R.parse_rules([e for e in entries if e["regex"] not in known], first)
        self._write_rules([*stored, *added])
        return added

    def add_rules_from_file(self, path: str) -> list[R.Rule]:
        return self.add_rules(rule._asdict() for rule in R.read_rules_file(path))

    def export_rules(self, path: str) -> None:
        """Write the rules as a file that ``add_rules_from_file`` reads."""
        R.write_rules_file(self.get_rules(), path)

    def delete_rule(self, rule_id: int) -> None:
        self._write_rules([rule for rule in self.get_rules() if rule.id != rule_id], [rule_id])

    # repositories

    def get_repos(self) -> DataFrame:
        """The latest scan of every repository; deleted ones are gone."""
        return self.store.repos()

    def get_repo(self, repo_url: str) -> DataFrame:
        return self.get_repos().filter(F.col("url") == repo_url)

    def _clear(self, batch: int, urls: DataFrame, *what: str) -> None:
        self.store.put("cleared", urls.select("url", F.explode(F.array(*map(F.lit, what))).alias("what")), batch)

    def delete_repo(self, repo_url: str) -> None:
        """Delete a repository with its discoveries and embeddings."""
        batch = self.store.new_batch()
        one = self.spark.createDataFrame([(repo_url, None, True)], "url string, last_scan bigint, deleted boolean")
        self._clear(batch, one, "discoveries", "embeddings")
        self.store.put("scans", one, batch)
        self.store.commit(batch, ["cleared", "scans"])

    # discoveries

    def get_discoveries(self, repo_url: str | None = None, with_rules: bool = False, **conditions) -> DataFrame:
        found = reports.filter_discoveries(self.store.discoveries(repo_url), **conditions)
        return reports.with_rules(found, self.rules()) if with_rules else found

    def get_discovery(self, discovery_id: int) -> DataFrame:
        return self.get_discoveries().filter(F.col("id") == discovery_id)

    def get_discovery_group(self, repo_url: str, state: str | None = None) -> DataFrame:
        return reports.discovery_groups(self.get_discoveries(repo_url), repo_url, state)

    def get_discoveries_count(self, repo_url: str | None = None, **conditions) -> int:
        return self.get_discoveries(repo_url, **conditions).count()

    def get_state_counts(self, repo_url: str | None = None) -> DataFrame:
        """(repo_url, file_name, state, n), kept up to date by every job instead of counted anew."""
        return self.store.counts(repo_url)

    def get_files_summary(self, repo_url: str) -> DataFrame:
        return reports.file_summary(self.get_discoveries(repo_url))

    def get_page(self, repo_url: str, limit: int, offset: int = 0, **options) -> DataFrame:
        return reports.discoveries_page(self.get_discoveries(repo_url), self.rules(), limit, offset,
                                        repo_url=repo_url, **options)

    def get_overview(self, active: Sequence[str] = ()) -> DataFrame:
        running = self.spark.createDataFrame([(url,) for url in active], "url string")
        return reports.repo_overview(self.get_repos(), self.get_discoveries(), running)

    def export_csv(self, path: str, repo_url: str, with_rules: bool = False, states: Sequence[str] = ()) -> None:
        found = self.get_discoveries(repo_url, with_rules)
        tables.export_csv(found.filter(F.col("state").isin(*states)) if states else found, path)

    def add_discoveries(self, found: DataFrame) -> DataFrame:
        """Store discoveries whose id is not stored yet, each id once; returns the ids (``id``) that were added."""
        batch = self.store.new_batch()
        fresh = tables.landed(self._unknown(found, self.store.discoveries()))
        self.store.commit(batch, self.store.put_discoveries(fresh, batch))
        return fresh.select("id")

    @staticmethod
    def _unknown(rows: DataFrame, stored: DataFrame) -> DataFrame:
        return rows.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti").select(*rows.columns)

    def update_discovery(self, discovery_id: int, state: str, by: str = "") -> bool:
        return self.update_discoveries([discovery_id], state, by)

    def update_discoveries(self, ids: Sequence[int] | DataFrame, state: str, by: str = "") -> bool:
        """Set the state of discoveries; False, and no change, for an unknown state."""
        if state not in schemas.STATES:
            return False
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], "id bigint")
        found = self.get_discoveries().filter(F.col("state") != state)
        self.store.change_states(found.join(ids.select("id").distinct(), "id", "left_semi"), state, by)
        return True

    def update_discovery_group(self, state: str, repo_url: str, file_name: str | None = None,
                               snippet: str | None = None, by: str = "") -> bool:
        if state not in schemas.STATES:
            return False
        found = self.get_discoveries(repo_url).filter(F.col("state") != state)
        for column, value in (("file_name", file_name), ("snippet", snippet)):
            if value is not None:
                found = found.filter(F.col(column) == value)
        self.store.change_states(found, state, by)
        return True

    def update_similar_snippets(self, snippet: str, state: str, repo_url: str, file_name: str | None = None,
                                compute_missing_embeddings: bool = False,
                                threshold: float = similarity.THRESHOLD,
                                encoder: M.Encoder | None = None, by: str = "") -> int:
        """Set the state of similar snippets in a repository; returns how many changed."""
        if compute_missing_embeddings:
            self.add_embeddings(repo_url, encoder)
        ids = triage.similar_discoveries(self.get_discoveries(repo_url), self.get_embeddings(), snippet, state,
                                         repo_url, file_name, threshold)
        changed = tables.landed(ids.distinct())
        count = changed.count()
        if count:
            self.store.change_states(self.get_discoveries(repo_url).join(changed, "id", "left_semi"), state, by)
        return count

    def update_group_and_similar(self, snippet: str, state: str, repo_url: str, file_name: str | None = None,
                                 threshold: float = similarity.THRESHOLD, by: str = "") -> bool:
        """Set a snippet's group in a file, then everything similar in the repository, as one change."""
        if state not in schemas.STATES:
            return False
        found = self.get_discoveries(repo_url).filter(F.col("state") != state)
        same = found.filter(F.col("snippet") == snippet)
        same = same if file_name is None else same.filter(F.col("file_name") == file_name)
        similar = triage.similar_discoveries(found, self.get_embeddings(), snippet, state, repo_url, threshold=threshold)
        self.store.change_states(found.join(same.select("id").union(similar).distinct(), "id", "left_semi"), state, by)
        return True

    def delete_discoveries(self, repo_url: str) -> None:
        batch = self.store.new_batch()
        self._clear(batch, self.spark.createDataFrame([(repo_url,)], "url string"), "discoveries")
        self.store.commit(batch, ["cleared"])

    # embeddings

    def get_embeddings(self, repo_url: str | None = None) -> DataFrame:
        return self.store.embeddings(repo_url)

    def get_embedding(self, discovery_id: int | None = None, snippet: str | None = None) -> DataFrame | None:
        if discovery_id is not None:
            return self.get_embeddings().filter(F.col("id") == discovery_id).select("id", "embedding")
        return None if snippet is None else similarity.embedding_by_snippet(self.get_embeddings(), snippet)

    def add_embeddings(self, repo_url: str, encoder: M.Encoder | None = None) -> None:
        """Embed the discoveries of a repository that have no embedding yet."""
        batch = self.store.new_batch()
        missing = M.without_embedding(self.get_discoveries(repo_url), self.get_embeddings(repo_url))
        self.store.put("embeddings", M.embed_discoveries(missing, encoder), batch)
        self.store.commit(batch, ["embeddings"])

    def delete_embeddings(self, repo_url: str) -> None:
        batch = self.store.new_batch()
        self._clear(batch, self.spark.createDataFrame([(repo_url,)], "url string"), "embeddings")
        self.store.commit(batch, ["cleared"])

    def delete_embedding(self, discovery_id: int) -> None:
        batch = self.store.new_batch()
        self.store.put("dropped", self.get_embeddings().filter(F.col("id") == discovery_id), batch)
        self.store.commit(batch, ["dropped"])

    # scans

    def store_scan(self, found: DataFrame, scanned: DataFrame, models: Sequence[str] = (), force: bool = False,
                   similar: bool = False, encoder: M.Encoder | None = None) -> DataFrame:
        """What every scan ends with: classify and store discoveries and the scan of ``scanned`` (url, last_scan), all in one
        batch. ``force`` takes the place of what is stored of those repositories.

        Returns the discoveries left for review, read from a landed copy.
        """
        classified = M.run_models(found, models, self.get_rules()).drop("flagged_by")
        fresh = tables.landed(classified)
        batch, written = self.store.new_batch(), ["scans"]
        if force:
            self._clear(batch, scanned, "discoveries", "embeddings")
            written.append("cleared")
            new = fresh.dropDuplicates(["id"])
        else:
            new = self._unknown(fresh, self.store.discoveries())
        written += self.store.put_discoveries(tables.landed(new), batch)
        if similar:
            vectors = M.embed_discoveries(fresh, encoder)
            vectors = vectors.dropDuplicates(["id"]) if force else self._unknown(vectors, self.store.embeddings())
            self.store.put("embeddings", vectors, batch)
            written.append("embeddings")
        self.store.put("scans", scanned.select("url", F.col("last_scan").cast("bigint").alias("last_scan"), F.lit(False).alias("deleted")), batch)
        self.store.commit(batch, written)
        return fresh.filter(F.col("state") != "false_positive")

    def _scanned_now(self, urls: DataFrame) -> DataFrame:
        return urls.select(F.col("repo_url").alias("url")).distinct().withColumn("last_scan", F.lit(int(time.time())))

    def scan(self, patches: DataFrame, commits: DataFrame, category: str | None = None,
             models: Sequence[str] = (), force: bool = False, similarity: bool = False,
             max_depth: int | None = None, encoder: M.Encoder | None = None) -> DataFrame:
        """Scan the history of every repository in ``commits`` since its last scan."""
        rules = R.scan_rules(self.get_rules(category))
        patches, commits = [frame.withColumn("repo_url", paths.normalise_url(F.col("repo_url")))
                            for frame in (patches, commits)]
        found = scans.scan_history(patches, commits, rules, 0 if force else self.get_repos(), max_depth)
        return self.store_scan(found, self._scanned_now(commits), models, force, similarity, encoder)

    def scan_user(self, patches: DataFrame, commits: DataFrame, repos_meta: DataFrame, owner: str,
                  forks: bool = False, **options) -> DataFrame:
        urls = repos_of(repos_meta, owner, forks).select("url")
        return self.scan(of_repos(patches, urls, "commit_id"), of_repos(commits, urls, "commit_id"), **options)

    def scan_wiki(self, patches: DataFrame, commits: DataFrame, repos: DataFrame,
                  category: str | None = None, models: Sequence[str] = ()) -> DataFrame:
        """Scan the wikis of repositories, always from the start."""
        urls = wiki_repos(repos.select("url"))
        chosen = of_repos(commits, urls, "commit_id")
        found = scans.scan_history(of_repos(patches, urls, "commit_id"), chosen,
                                   R.scan_rules(self.get_rules(category)))
        return self.store_scan(found, self._scanned_now(chosen), models, True, False, None)

    def scan_snapshot(self, files: DataFrame, refs: DataFrame, commits: DataFrame, requests: DataFrame,
                      patches: DataFrame | None = None, category: str | None = None,
                      models: Sequence[str] = (), force: bool = False, max_depth: int = -1,
                      ignore_list: Sequence[str] = (), similarity: bool = False,
                      encoder: M.Encoder | None = None) -> DataFrame:
        """Scan the requested (repo_url, name) snapshots.

        Of a repository that was scanned before, only what changed since the commit of that time is
        scanned: by the patch between the two commits if it is landed, else by comparing their files.
        If the files of the earlier commit aren't there either, the snapshot is scanned whole.
        ``last_scan`` becomes the time of the scanned commit. A request for an unknown commit raises
        ValueError.
        """
        rules = R.scan_rules(self.get_rules(category))
        resolved = C.resolve_refs(requests, refs)
        unknown = C.unknown_snapshots(resolved, commits, of_commits(files, resolved)).select("repo_url", "name").limit(10).collect()
        if unknown:
            raise ValueError("unknown snapshots: " + ", ".join(f"{row.repo_url} {row.name}" for row in unknown))
        dates = C.commit_timestamps(requests, refs, commits).select(
            F.col("repo_url").alias("url"), F.col("committed_date").alias("last_scan"))
        whole = requests
        parts = []
        if not force:
            known = self.get_repos().filter(F.col("last_scan") > 0)
            delta = tables.landed(C.snapshot_delta(commits, known, resolved).distinct())
            ready = C.landed_deltas(delta, self.spark.createDataFrame([], schemas.PATCHES) if patches is None else patches)
            held = of_commits(files, delta.select("repo_url", F.col("commit_from").alias("commit_id")))
            compared = (delta.join(ready, ["repo_url", "commit_id"], "left_anti")
                        .join(held.select("repo_url", F.col("commit_id").alias("commit_from")).distinct(),
                              ["repo_url", "commit_from"], "left_semi"))
            done = ready.unionByName(compared.select("repo_url", "commit_id")).distinct()
            whole = resolved.join(done, ["repo_url", "commit_id"], "left_anti").select(*requests.columns)
            if patches is not None:
                parts.append(scans.scan_snapshot_delta(patches, commits, known, refs, requests, rules))
            parts.append(scans.scan_snapshot_diff(files, compared, rules, max_depth, ignore_list))
        parts.append(scans.scan_snapshot(files, refs, whole, rules, max_depth, ignore_list))
        found = reduce(DataFrame.unionByName, parts)
        return self.store_scan(found, dates, models, force, similarity, encoder)

    def _known(self, repo_url: str) -> bool:
        return not self.get_repos().filter(F.col("url") == repo_url).isEmpty()

    def scan_path(self, path: str, category: str | None = None, models: Sequence[str] = (),
                  force: bool = False, max_depth: int = -1, ignore_list: Sequence[str] = (),
                  similarity: bool = False, encoder: M.Encoder | None = None) -> DataFrame:
        """Scan a folder or file; a path that was scanned before needs ``force``."""
        if not force and self._known(path):
            raise ValueError(f"{path} has already been scanned, use force to scan it again")
        rules = R.scan_rules(self.get_rules(category))
        found = scans.scan_path(self.spark, path, rules, max_depth, ignore_list)
        one = self.spark.createDataFrame([(path,)], "repo_url string")
        return self.store_scan(found, self._scanned_now(one), models, force, similarity, encoder)

    def scan_pull_request(self, pr_commits: DataFrame, repo_url: str, pr_number: int,
                          category: str | None = None, models: Sequence[str] = (), force: bool = False,
                          similarity: bool = False, encoder: M.Encoder | None = None) -> DataFrame:
        """Scan one pull request; a repository that was scanned before yields nothing."""
        repo_url = paths.normalise_url_text(repo_url)
        rules = R.scan_rules(self.get_rules(category))
        if not force and self._known(repo_url):
            return self.spark.createDataFrame([], schemas.DISCOVERIES)
        found = scans.scan_pull_requests(pr_commits, rules, repo_url, pr_number)
        one = self.spark.createDataFrame([(repo_url,)], "repo_url string")
        return self.store_scan(found, self._scanned_now(one), models, force, similarity, encoder)
