"""Scan jobs: from landed sources to discoveries, each one lazy plan.

A job covers every repository in its input at once; ``repo_url`` is a plain column.
Lines are numbered and matched inside the input row, so a scan shuffles nothing but
commit metadata and matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.functions.text import is_scannable_row, patch_row_snippet, strip
from keysieve.operators import models as M
from keysieve.operators.lines import decode_utf8, file_lines, patch_lines
from keysieve.operators.matching import match_lines
from keysieve.operators.skew import is_small, salted_join
from keysieve.operators.tables import discovery_id, landed
from keysieve.schemas import DISCOVERIES
from keysieve.sources import commits as C
from keysieve.sources import files as S
from keysieve.sources import patches as P
from keysieve.sources import snapshots as D
from keysieve.sources import trees
from keysieve.sources.repos import of_commits, of_repos, repos_of, wiki_repos
from keysieve.sources.rules import Rule

_KEY = ["repo_url", "commit_id", "file_name"]


def to_discoveries(matches: DataFrame, discovered: Column | None = None, ids: Column | None = None) -> DataFrame:
    """Shape matches as rows of the discoveries table, in state ``new``."""
    made = matches.select(
        (ids if ids is not None else discovery_id()).alias("id"), "file_name", "commit_id", "line_number",
        "snippet", "repo_url", "rule_id", F.lit("new").alias("state"),
        (discovered if discovered is not None else F.current_timestamp()).alias("timestamp"))
    return made.select(*DISCOVERIES.fieldNames())


def scan_files(files: DataFrame, rules: Sequence[Rule], content: str = "content", **shape) -> DataFrame:
    """Scan whole files: (repo_url, commit_id, file_name, content as text)."""
    return to_discoveries(match_lines(file_lines(files, content, rules), rules), **shape)


def scan_patches(patches: DataFrame, rules: Sequence[Rule], count_long_rows: bool = False, **shape) -> DataFrame:
    """Scan patches: (repo_url, commit_id, file_name, patch)."""
    lines = patch_lines(patches, "patch", rules, count_long_rows)
    return to_discoveries(match_lines(lines, rules), **shape)


def history_pairs(commits: DataFrame, since: int | Column = 0, max_depth: int | None = None,
                  scanned: DataFrame | None = None) -> DataFrame:
    """The commit pairs a history scan looks at, each once across branches."""
    listed = commits if max_depth is None else C.newest_commits(commits, max_depth)
    pairs = C.pairs_since(listed, since)
    if scanned is not None:
        pairs = C.new_pairs_only(pairs, scanned)
    return C.unique_pairs(pairs)


def scan_history(patches: DataFrame, commits: DataFrame, rules: Sequence[Rule], since: int | DataFrame = 0,
                 max_depth: int | None = None, **shape) -> DataFrame:
    """Scan the commits of all branches that are newer than ``since``, a time or a
    repos table (url, last_scan) with a time per repository.

    A first scan (no time, or 0) also scans the oldest listed commit of every branch
    against the empty tree.

    Patches are matched before they meet the commit pairs: the join moves the matches,
    a small part of the patch text, and a commit that holds most of them is salted.
    """
    listed_patches = P.history_patches(patches)
    if isinstance(since, DataFrame):
        times = since.select(F.col("url").alias("repo_url"), F.coalesce("last_scan", F.lit(0)).alias("_since"))
        listed = (salted_join(commits, times, ["repo_url"], F.col("commit_id"), how="left")
                  .withColumn("_since", F.coalesce("_since", F.lit(0).cast("bigint"))))
    else:
        listed = commits.withColumn("_since", F.lit(since).cast("bigint"))
        if since:
            date = F.col("committed_date")
            listed_patches = listed_patches.filter(date.isNull() | (date > since))
    wanted = history_pairs(listed, F.col("_since"), max_depth).select(*C.PAIR)
    if isinstance(since, DataFrame) or since == 0:
        first = listed.filter(F.col("_since") == 0)
        roots = C.root_commits(first if max_depth is None else C.newest_commits(first, max_depth))
        wanted = wanted.unionByName(roots.withColumn("parent_id", F.lit(None).cast("string")))
    return to_discoveries(_in_pairs(listed_patches, wanted, rules), **_by_parent(shape))


def _by_parent(shape: dict) -> dict:
    """A commit with two parents is compared with both, so its discoveries have an id for each."""
    return {"ids": discovery_id("_parent"), **shape}


def _in_pairs(patches: DataFrame, pairs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Matches in the patches of the given pairs; a first commit has no parent.

    Few enough pairs are sent to the patches, so only wanted ones are split and matched. Otherwise the matches go to the
    pairs, not the patch text.
    """
    no_parent = F.coalesce("parent_id", F.lit("")).alias("_parent")
    rows = patches.select("repo_url", "commit_id", no_parent, "file_name", "patch")
    wanted = pairs.select("repo_url", "commit_id", no_parent)
    if is_small(wanted, 100_000, 32_000_000):
        few = rows.join(F.broadcast(wanted), ["repo_url", "commit_id", "_parent"], "left_semi")
        return match_lines(patch_lines(few, "patch", rules), rules)
    matches = match_lines(patch_lines(rows, "patch", rules), rules)
    return salted_join(matches, wanted,
                       ["repo_url", "commit_id", "_parent"], F.struct("file_name", "line_number"), 8, "left_semi")


def scan_snapshot(files: DataFrame, refs: DataFrame, requests: DataFrame, rules: Sequence[Rule],
                  max_depth: int = -1, ignore_list: Sequence[str] = (), content: str = "content",
                  **shape) -> DataFrame:
    """Scan all files of the requested branches or commits.

    As with histories, the matches are joined with the requests, not the contents; a
    few requested commits also prune the files that are read.
    """
    wanted = C.resolve_refs(requests, refs).select("repo_url", "commit_id").distinct()
    chosen = of_commits(S.prune(files, max_depth, ignore_list), wanted)
    matches = match_lines(file_lines(chosen, content, rules), rules)
    return to_discoveries(S.in_snapshots(matches, wanted), **shape)


def scan_snapshot_delta(patches: DataFrame, commits: DataFrame, repos: DataFrame, refs: DataFrame,
                        requests: DataFrame, rules: Sequence[Rule], **shape) -> DataFrame:
    """Scan what changed between the last scanned commit and the requested one."""
    delta = C.snapshot_delta(commits, repos, C.resolve_refs(requests, refs))
    wanted = delta.select("repo_url", "commit_id", F.col("commit_from").alias("parent_id")).distinct()
    chosen = of_commits(P.patch_rows(patches), wanted)
    return to_discoveries(_in_pairs(chosen, wanted, rules), **_by_parent(shape))


def scan_snapshot_diff(files: DataFrame, pairs: DataFrame, rules: Sequence[Rule], max_depth: int = -1,
                       ignore_list: Sequence[str] = (), content: str = "content", ignore_space: bool = True, **shape) -> DataFrame:
    """Scan the lines that differ between the commits of pairs (repo_url, commit_from, commit_id), whose files are all in
    ``files``: no patch has to be there.

    As in patches, lines over 500 characters with their sign are not scanned and others are trimmed; their numbers are
    those of the new file.
    """
    wanted = pairs.select("repo_url", F.explode(F.array("commit_from", "commit_id")).alias("commit_id")).distinct()
    chosen = of_commits(S.prune(files, max_depth, ignore_list), wanted)
    diff = D.snapshot_diff(chosen, pairs, content, ignore_space).filter(F.col("change_type") != "D")
    row = F.concat(F.lit("+"), F.col("line"))
    lines = (D.added_lines(diff).filter(is_scannable_row(row))
             .withColumn("snippet", patch_row_snippet(row)).withColumn("match_text", F.col("snippet"))
             .withColumn("_parent", F.col("commit_from")))
    return to_discoveries(match_lines(lines, rules), **_by_parent(shape))


def scan_path(spark: SparkSession, root: str, rules: Sequence[Rule], max_depth: int = -1,
              ignore_list: Sequence[str] = (), piece_bytes: int = trees.PIECE_BYTES, **shape) -> DataFrame:
    """Scan a folder or a single file; files that are not UTF-8 are skipped whole.

    Files of more than ``piece_bytes`` are read in pieces, by several tasks.
    """
    if not trees.can_open(root):
        return scan_files(decode_utf8(S.read_tree(spark, root, max_depth, ignore_list)), rules, **shape)
    cut = trees.pieces(landed(trees.list_tree(spark, root, max_depth, ignore_list)), piece_bytes)
    texts = trees.read_pieces(cut, root).filter(F.col("content").isNotNull()).withColumns(
        {"repo_url": F.lit(root), "commit_id": F.lit("")})
    found = match_lines(file_lines(texts, rules=rules), rules)
    return to_discoveries(trees.numbered(found, trees.lines_before(cut, root)), **shape)


def scan_pull_requests(pr_commits: DataFrame, rules: Sequence[Rule], repo_url: str | None = None,
                       pr_number: int | None = None, **shape) -> DataFrame:
    chosen = pr_commits
    if repo_url is not None:
        chosen = chosen.filter(F.col("repo_url") == repo_url)
    if pr_number is not None:
        chosen = chosen.filter(F.col("pr_number") == pr_number)
    return scan_patches(P.pull_request_patches(chosen), rules, **shape)


def scan_user(patches: DataFrame, commits: DataFrame, repos_meta: DataFrame, owner: str,
              rules: Sequence[Rule], forks: bool = False, **options) -> DataFrame:
    """Scan the history of all repositories of a user or organisation."""
    urls = repos_of(repos_meta, owner, forks).select("url")
    return scan_history(of_repos(patches, urls, "commit_id"), of_repos(commits, urls, "commit_id"), rules, **options)


def scan_wiki(patches: DataFrame, commits: DataFrame, repos: DataFrame, rules: Sequence[Rule],
              **shape) -> DataFrame:
    """Scan the wiki repositories of the given repositories, always from the start."""
    urls = wiki_repos(repos.select("url"))
    return scan_history(of_repos(patches, urls, "commit_id"), of_repos(commits, urls, "commit_id"), rules,
                        since=0, **shape)


def scan_staged(name_status: DataFrame, diffs: DataFrame, rules: Sequence[Rule],
                models: Sequence[str] = ("path", "password"), **shape) -> DataFrame:
    """What a commit gate reports: findings in the added lines of staged files that no
    model takes for a false positive. Keys: repo_url, commit_id, file_name.

    Discoveries of password rules are reported while they are ``new``, all others
    whatever their state.
    """
    staged = diffs.join(P.staged_files(name_status).select(*_KEY), _KEY, "left_semi")
    lines = (P.added_lines(staged)
             .withColumn("match_text", F.concat("line", F.lit("\n")))
             .withColumn("snippet", strip(F.col("line"))))
    found = to_discoveries(match_lines(lines, rules), **shape)
    classified = M.run_models(found, models, rules)
    passwords = [rule.id for rule in rules if rule.category == "password"]
    is_password = F.col("rule_id").isin(passwords) if passwords else F.lit(False)
    return classified.filter(~is_password | (F.col("state") == "new"))
