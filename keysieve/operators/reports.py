"""Counts, nested views, pages and exports of discoveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keysieve.functions.labels import RULE_DELETED, state_rank
from keysieve.functions.text import finding_text
from keysieve.operators.pages import RANGE_ROWS, PageIndex
from keysieve.operators.skew import lookup_join, with_parts
from keysieve.schemas import STATES

UNIQUE = ["snippet", "state", "rule_id"]
NEST = ["snippet", "category", "state"]
PART_ROWS = 10_000
# Pages up to this many groups are broadcast as keys; larger ones are joined as Spark sees fit.
SMALL_PAGE = 1000


def filter_discoveries(discoveries: DataFrame, repo_url: str | None = None, file_name: str | None = None,
                       state: str | None = None, where: str | None = None,
                       ignore_case: bool = False) -> DataFrame:
    """All given conditions hold; ``where`` is a part of the snippet."""
    for column, value in (("repo_url", repo_url), ("file_name", file_name), ("state", state)):
        if value is not None:
            discoveries = discoveries.filter(F.col(column) == value)
    if where is not None:
        snippet = F.col("snippet")
        found = F.lower(snippet).contains(where.lower()) if ignore_case else snippet.contains(where)
        discoveries = discoveries.filter(found)
    return discoveries


def with_rules(discoveries: DataFrame, rules: DataFrame) -> DataFrame:
    details = rules.select(F.col("id").alias("rule_id"), F.col("regex").alias("rule_regex"),
                           F.col("category").alias("rule_category"),
                           F.col("description").alias("rule_description"))
    return (lookup_join(discoveries, details, "rule_id", F.col("id"))
            .select(*discoveries.columns, "rule_regex", "rule_category", "rule_description"))


def with_category(discoveries: DataFrame, rules: DataFrame) -> DataFrame:
    categories = rules.select(F.col("id").alias("rule_id"), "category")
    return (lookup_join(discoveries, categories, "rule_id", F.col("id"))
            .select(*discoveries.columns, F.coalesce("category", F.lit(RULE_DELETED)).alias("category")))


def _in_state(state: str) -> Column:
    return F.count_if(F.col("state") == state)


def repo_state_counts(discoveries: DataFrame) -> DataFrame:
    return discoveries.groupBy("repo_url").agg(
        F.count("*").alias("total"), _in_state("new").alias("true_positive"),
        *[_in_state(state).alias(state) for state in STATES if state != "new"])


def repo_overview(repos: DataFrame, discoveries: DataFrame, active: DataFrame) -> DataFrame:
    """Every repository with its counts, zero where nothing was found.

    ``active`` lists the urls being scanned right now; they come first, then the most
    recently scanned.
    """
    counts = repo_state_counts(discoveries).select(
        F.col("repo_url").alias("url"), "total", F.col("true_positive").alias("TP"),
        F.col("false_positive").alias("FP"), "addressing", "not_relevant", "fixed")
    running = active.select("url").distinct().withColumn("scan_active", F.lit(True))
    joined = repos.join(counts, "url", "left").join(running, "url", "left")
    return (joined.fillna(0, ["total", "TP", "FP", "addressing", "not_relevant", "fixed"])
            .fillna(False, ["scan_active"])
            .orderBy(F.desc("scan_active"), F.desc_nulls_last("last_scan"), "url"))


def file_summary(discoveries: DataFrame, repo_url: str | None = None) -> DataFrame:
    """Per file; ``fixed`` discoveries count in the total only."""
    return filter_discoveries(discoveries, repo_url).groupBy("repo_url", "file_name").agg(
        F.count("*").alias("tot_discoveries"), _in_state("new").alias("new"),
        _in_state("false_positive").alias("false_positives"),
        _in_state("addressing").alias("addressing"), _in_state("not_relevant").alias("not_relevant"))


def top_files(discoveries: DataFrame, repo_url: str | None = None) -> DataFrame:
    return file_summary(discoveries, repo_url).orderBy(F.desc("new"), "repo_url", "file_name")


def discovery_groups(discoveries: DataFrame, repo_url: str | None = None, state: str | None = None) -> DataFrame:
    return (filter_discoveries(discoveries, repo_url, state=state)
            .groupBy("file_name", "snippet", "state").agg(F.count("*").alias("occurrences")))


def count_discoveries(discoveries: DataFrame, **conditions) -> DataFrame:
    return filter_discoveries(discoveries, **conditions).agg(F.count("*").alias("total"))


def left_for_review(discoveries: DataFrame) -> DataFrame:
    return discoveries.agg(F.count_if(F.col("state") != "false_positive").alias("left_for_review"))


def grand_totals(repos: DataFrame, discoveries: DataFrame) -> DataFrame:
    """Repositories, discoveries and files with discoveries."""
    files = discoveries.groupBy("repo_url", "file_name").agg(F.count("*").alias("rows"))
    return files.agg(
        repos.agg(F.count("*").alias("n")).scalar().alias("repos"),
        F.count("*").alias("unique_files"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("discoveries"))


def ids_by_repo(discoveries: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Ids of every repository as sorted arrays, several for a large repository."""
    return (with_parts(discoveries.select("repo_url", "id"), ["repo_url"], "id", part_rows)
            .groupBy("repo_url", "part").agg(F.sort_array(F.collect_list("id")).alias("ids")))


def _occurrence() -> Column:
    return F.struct("file_name", "line_number", "commit_id", "id")


def nested_occurrences(categorised: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per (snippet, category, state) with the array of its occurrences.

    A group with more than ``part_rows`` occurrences comes as several rows, told
    apart by ``part``, so that no single array grows with the data.
    """
    columns = [*NEST, "file_name", "line_number", "commit_id", "id"]
    return (with_parts(categorised.select(*columns), NEST, "id", part_rows)
            .groupBy(*NEST, "part").agg(F.array_sort(F.collect_list(_occurrence())).alias("occurrences")))


def occurrence_preview(categorised: DataFrame, shown: int = 10) -> DataFrame:
    """The first occurrences of every group, by id, and how many more there are.

    Each task keeps at most ``shown`` rows of a group before the shuffle.
    """
    first = (categorised.select(*NEST, "file_name", "line_number", "commit_id", "id")
             .withColumn("_place", F.row_number().over(W.partitionBy(*NEST).orderBy("id")))
             .filter(F.col("_place") <= shown))
    previews = first.groupBy(*NEST).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "file_name", "line_number", "commit_id"))),
                    lambda o: F.struct(o["file_name"].alias("file_name"), o["line_number"].alias("line_number"),
                                       o["commit_id"].alias("commit_id"), o["id"].alias("id"))).alias("occurrences"))
    totals = categorised.groupBy(*NEST).agg(F.count("*").alias("total"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in NEST]
    return (previews.alias("p").join(totals.alias("t"), same)
            .select(*[F.col(f"p.{k}") for k in NEST], "occurrences", "total",
                    F.greatest(F.col("total") - shown, F.lit(0)).alias("more")))


def unique_groups(discoveries: DataFrame, **conditions) -> DataFrame:
    """Distinct (snippet, state, rule_id) with the number of such groups."""
    groups = filter_discoveries(discoveries, **conditions).groupBy(*UNIQUE).agg(F.count("*").alias("occurrences"))
    return groups.withColumn("total", groups.agg(F.count("*").alias("n")).scalar())


def _page_order(order_by: str, descending: bool) -> list[Column]:
    key = "rule_id" if order_by == "category" else order_by
    # Nulls sort lowest, as in the stores this replaces.
    order = [F.desc_nulls_last(key) if descending else F.asc_nulls_first(key)]
    return order + [F.asc_nulls_first(k) for k in ("snippet", "state", "rule_id") if k != key]


def page_groups(discoveries: DataFrame, limit: int | None = None, offset: int = 0, order_by: str = "snippet",
                descending: bool = False, **conditions) -> DataFrame:
    """One page of unique groups, ordered by category, snippet or state."""
    if order_by not in ("category", "snippet", "state"):
        raise ValueError(f"cannot order by {order_by!r}")
    if limit is not None and limit < 1:
        raise ValueError("a page holds at least one group")
    page = unique_groups(discoveries, **conditions).orderBy(*_page_order(order_by, descending))
    if offset:
        page = page.offset(offset)
    return page if limit is None else page.limit(limit)


def paged_groups(discoveries: DataFrame, path: str, order_by: str = "snippet", descending: bool = False,
                 range_rows: int = RANGE_ROWS, **conditions) -> PageIndex:
    """All pages of unique groups, cut into ranges below ``path``: a page of any depth reads a range or two."""
    if order_by not in ("category", "snippet", "state"):
        raise ValueError(f"cannot order by {order_by!r}")
    return PageIndex.build(unique_groups(discoveries, **conditions), path, _page_order(order_by, descending), range_rows)


def page_occurrences(discoveries: DataFrame, page: DataFrame, bounded: bool = False,
                     repo_url: str | None = None, file_name: str | None = None,
                     state: str | None = None) -> DataFrame:
    """All occurrences of a page's (snippet, state) pairs.

    ``bounded`` says that the page was limited to at most ``SMALL_PAGE`` groups. Its keys
    are fixed-width digests, so their broadcast stays far below a megabyte.
    """
    digest = F.sha2(F.coalesce("snippet", F.lit("")), 256).alias("_digest")
    keys = page.select(digest, F.col("state").alias("_state")).distinct()
    if bounded:
        keys = F.broadcast(keys)
    rows = filter_discoveries(discoveries, repo_url, file_name, state).withColumn(
        "_digest", F.sha2(F.coalesce("snippet", F.lit("")), 256))
    found = rows.join(keys, (rows["_digest"] == keys["_digest"]) & (rows["state"] == keys["_state"]), "left_semi")
    return found.drop("_digest")


def discoveries_page(discoveries: DataFrame, rules: DataFrame, limit: int, offset: int = 0,
                     order_by: str = "snippet", descending: bool = False, where: str | None = None,
                     **conditions) -> DataFrame:
    """The triage page: page of groups, their occurrences, category, nesting, in the order of the groups.

    The text filter selects groups; the occurrences follow from (snippet, state). ``place`` (from 1) is the place on the
    page of the first group with the snippet and state.
    """
    page = page_groups(discoveries, limit, offset, order_by, descending, where=where, **conditions)
    occurrences = page_occurrences(discoveries, page, limit <= SMALL_PAGE, **conditions)
    # A page is numbered by one task, as it was put in order by one; it has ``limit`` rows.
    places = (page.withColumn("place", F.row_number().over(W.orderBy(*_page_order(order_by, descending))))
              .groupBy(F.col("snippet").alias("_snippet"), F.col("state").alias("_state")).agg(F.min("place").alias("place")))
    nested = nested_occurrences(with_category(occurrences, rules))
    placed = nested.join(places, F.col("snippet").eqNullSafe(F.col("_snippet")) & F.col("state").eqNullSafe(F.col("_state")))
    return placed.select("place", *nested.columns).orderBy("place", "category", "part")


def ranked_occurrences(categorised: DataFrame) -> DataFrame:
    return (categorised.withColumn("state_rank", state_rank(F.col("state")))
            .orderBy("snippet", "category", "state_rank", "id"))


def newest_ids(discoveries: DataFrame, repo_url: str, n: int) -> DataFrame:
    return filter_discoveries(discoveries, repo_url).select("id").orderBy(F.desc("id")).limit(n)


def export_by_states(discoveries: DataFrame, repo_url: str, states: Sequence[str]) -> DataFrame:
    return filter_discoveries(discoveries, repo_url).filter(F.col("state").isin(*states))


def preview(discoveries: DataFrame, rows: int = 30) -> DataFrame:
    """What a terminal shows: the first rows, without store columns."""
    text = [F.col(c).cast("string").alias(c) if c in ("id", "line_number") else F.col(c)
            for c in discoveries.columns if c not in ("repo_url", "timestamp", "rule_id")]
    return discoveries.orderBy("id").limit(rows).select(*text)


def gate_count(discoveries: DataFrame) -> DataFrame:
    return discoveries.agg(F.count("*").alias("exit_status"))


def report_text(discoveries: DataFrame, block: int = 1000) -> DataFrame:
    """The findings of a file as one text, in line order.

    A line has at most one discovery, so a text covers at most ``block`` findings; a
    file with findings further down has several texts, told apart by ``part``.
    """
    part = F.floor((F.col("line_number") - 1) / block).cast("int").alias("part")
    entry = F.struct("line_number", "id", finding_text(F.col("file_name"), F.col("snippet"),
                                                       F.col("line_number")).alias("text"))
    return (discoveries.groupBy("repo_url", "commit_id", "file_name", part)
            .agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
            .select("repo_url", "commit_id", "file_name", "part",
                    F.array_join(F.col("_entries.text"), "").alias("report")))
