"""Tables that only grow: batches of rows, changes of rows, and a log that makes batches count.

A job writes its rows into folders of their own and then one row into the log. Readers take the batches in the log, so a job
that fails at any point before has changed nothing. State changes are rows too: (id, state, at), folded on read, so
setting the state of a million discoveries writes a million narrow rows and rewrites none.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve import schemas
from keysieve.operators.skew import lookup_join
from keysieve.operators.tables import BUCKETS, bucket_value, landed

# What a store holds. Tables with a repo_url are cut into buckets by it; ``batch``, the time of the job, is a folder.
CHANGES = T.StructType([T.StructField("id", T.LongType()), T.StructField("repo_url", T.StringType()),
                        T.StructField("state", T.StringType()), T.StructField("by", T.StringType())])
TABLES = {
    "rules": schemas.RULES, "discoveries": schemas.DISCOVERIES, "embeddings": schemas.EMBEDDINGS, "changes": CHANGES,
    "scans": T.StructType([*schemas.REPOS, T.StructField("deleted", T.BooleanType())]),
    # Repositories whose rows in a table (``what``) of earlier batches are gone, and single embeddings that are.
    "cleared": T.StructType([T.StructField("url", T.StringType()), T.StructField("what", T.StringType())]),
    "dropped": T.StructType([T.StructField("id", T.LongType()), T.StructField("repo_url", T.StringType())]),
    # How many discoveries of a file a batch puts into a state (n > 0) or takes out of it (n < 0).
    "counts": T.StructType([*(T.StructField(c, T.StringType()) for c in ("repo_url", "file_name", "state")), T.StructField("n", T.LongType())]),
    "deleted_rules": T.StructType([T.StructField("rule_id", T.IntegerType())]),
}
_LOG = "at long, tables array<string>, replaces array<string>"


def fold_states(rows: DataFrame, changes: DataFrame, since: str = "batch") -> DataFrame:
    """The rows (id, state, ``since``, ...) with the state of the latest change (id, state, at) made after a row was stored.

    Of changes with the same time the state that sorts last counts; a change to an unknown id does nothing.
    """
    last = changes.groupBy("id").agg(F.max(F.struct("at", "state")).alias("_last"))
    newer = F.coalesce(F.col("_last.at") > F.col(since), F.lit(False))
    return (rows.join(last, "id", "left").withColumn("state", F.when(newer, F.col("_last.state")).otherwise(F.col("state")))
            .select(*rows.columns))


def state_deltas(targets: DataFrame, state: str | None = None) -> DataFrame:
    """What rows (repo_url, file_name, state) add to the counts: one each, or, if their state becomes another one, one less
    of the old and one more of the new."""
    def one(value: Column, n: int) -> Column:
        return F.struct(value.alias("state"), F.lit(n).alias("n"))

    signed = [one(F.col("state"), 1)] if state is None else [one(F.col("state"), -1), one(F.lit(state), 1)]
    rows = targets.select("repo_url", "file_name", F.inline(F.array(*signed)))
    return rows.groupBy("repo_url", "file_name", "state").agg(F.sum("n").alias("n"))


def without_cleared(rows: DataFrame, cleared: DataFrame, spread: str = "id") -> DataFrame:
    """The rows (repo_url, batch, ...) without those of a repository that was cleared (url, batch) after they were stored."""
    times = cleared.groupBy(F.col("url").alias("repo_url")).agg(F.max("batch").alias("_cleared"))
    joined = lookup_join(rows, times, "repo_url", F.col(spread))
    return joined.filter(F.col("_cleared").isNull() | (F.col("batch") >= F.col("_cleared"))).select(*rows.columns)


class Store:
    """A folder that every executor can reach. One driver at a time writes to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._last = 0

    def _entries(self) -> list[Row]:
        """The log, a row for each job since the last compaction and before it."""
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.root}/log").orderBy("at").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def new_batch(self) -> int:
        self._last = max(time.time_ns(), self._last + 1)
        return self._last

    def put(self, table: str, frame: DataFrame, batch: int) -> None:
        """Write rows of a batch; they don't count until the batch is committed."""
        frame = frame.select(*TABLES[table].fieldNames())
        path = f"{self.root}/{table}/batch={batch}"
        if "repo_url" in frame.columns:
            bucket = F.pmod(F.xxhash64("repo_url"), F.lit(BUCKETS)).cast("int")
            # Rebalancing splits a bucket that one repository dominates over several files.
            frame.withColumn("repo_bucket", bucket).hint("rebalance", "repo_bucket").write.mode("overwrite").partitionBy("repo_bucket").parquet(path)
        else:
            frame.write.mode("overwrite").parquet(path)

    def commit(self, batch: int, tables: Sequence[str], replaces: Sequence[str] = ()) -> None:
        """Make a batch count for ``tables``, alone for those it ``replaces``: one row in one file."""
        (self.spark.createDataFrame([(batch, list(tables), list(replaces))], _LOG).coalesce(1)
         .write.mode("append").parquet(f"{self.root}/log"))

    def _batches(self, table: str, entries: Sequence[Row] | None = None) -> list[int]:
        batches: list[int] = []
        for entry in self._entries() if entries is None else entries:
            if table in entry.replaces:
                batches = []
            if table in entry.tables:
                batches.append(entry.at)
        return batches

    def rows(self, table: str, repo_url: str | None = None, entries: Sequence[Row] | None = None) -> DataFrame:
        """The rows that count, with their ``batch``. Naming a repository reads its bucket only."""
        batches = self._batches(table, entries)
        schema = T.StructType([*TABLES[table], T.StructField("batch", T.LongType())])
        if not batches:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{table}/batch={b}" for b in batches]
        bucketed = "repo_url" in TABLES[table].fieldNames()
        full = T.StructType([*schema, T.StructField("repo_bucket", T.IntegerType())]) if bucketed else schema
        found = self.spark.read.schema(full).option("basePath", f"{self.root}/{table}").parquet(*paths)
        if repo_url is not None:
            found = found.filter((F.col("repo_bucket") == bucket_value(repo_url)) & (F.col("repo_url") == repo_url))
        return found.select(*schema.fieldNames())

    def _kept(self, table: str, repo_url: str | None, entries: Sequence[Row]) -> DataFrame:
        rows = self.rows(table, repo_url, entries)
        if not self._batches("cleared", entries):
            return rows
        what, spread = ("discoveries", "file_name") if table == "counts" else (table, "id")
        return without_cleared(rows, self.rows("cleared", entries=entries).filter(F.col("what") == what), spread)

    def put_discoveries(self, frame: DataFrame, batch: int) -> list[str]:
        """Write discoveries and what they add to the counts; returns the tables to commit."""
        self.put("discoveries", frame, batch)
        self.put("counts", state_deltas(frame), batch)
        return ["discoveries", "counts"]

    def counts(self, repo_url: str | None = None) -> DataFrame:
        """(repo_url, file_name, state, n): the number of discoveries now, added up from what each batch changed."""
        rows = self._kept("counts", repo_url, self._entries())
        return rows.groupBy("repo_url", "file_name", "state").agg(F.sum("n").alias("n")).filter("n <> 0")

    def discoveries(self, repo_url: str | None = None) -> DataFrame:
        """The discoveries as they are now."""
        entries = self._entries()
        rows = self._kept("discoveries", repo_url, entries)
        if self._batches("changes", entries):
            rows = fold_states(rows, self.rows("changes", repo_url, entries).withColumnRenamed("batch", "at"))
        rule = F.col("rule_id")
        if self._batches("deleted_rules", entries):
            # One for each rule that a user deleted since the last compaction.
            for gone in self.rows("deleted_rules", entries=entries).collect():
                rule = F.when((F.col("rule_id") == gone.rule_id) & (F.col("batch") < gone.batch), F.lit(None)).otherwise(rule)
        return rows.withColumn("rule_id", rule.cast("int")).select(*schemas.DISCOVERIES.fieldNames())

    def embeddings(self, repo_url: str | None = None) -> DataFrame:
        entries = self._entries()
        rows = self._kept("embeddings", repo_url, entries)
        if self._batches("dropped", entries):
            dropped = self.rows("dropped", repo_url, entries).groupBy("id").agg(F.max("batch").alias("_dropped"))
            rows = rows.join(dropped, "id", "left").filter(F.col("_dropped").isNull() | (F.col("batch") > F.col("_dropped")))
        return rows.select(*schemas.EMBEDDINGS.fieldNames())

    def repos(self) -> DataFrame:
        """(url, last_scan) of the latest scan of every repository; deleted ones are gone."""
        latest = self.rows("scans").groupBy("url").agg(F.max_by(F.struct("last_scan", "deleted"), "batch").alias("e"))
        return latest.filter(~F.col("e.deleted")).select("url", "e.last_scan")

    def rules(self) -> DataFrame:
        return self.rows("rules").drop("batch")

    def change_states(self, targets: DataFrame, state: str, by: str = "") -> None:
        """Set the state of discoveries as they are now, each of them once and in another state."""
        targets = landed(targets.select("id", "repo_url", "file_name", "state"))
        batch = self.new_batch()
        self.put("changes", targets.select("id", "repo_url", F.lit(state).alias("state"), F.lit(by).alias("by")), batch)
        self.put("counts", state_deltas(targets, state), batch)
        self.commit(batch, ["changes", "counts"])

    def history(self, discovery_id: int) -> DataFrame:
        """(state, by, at) of the changes of a discovery since the last compaction, oldest first."""
        found = self.rows("changes").filter(F.col("id") == discovery_id)
        return found.select("state", "by", F.col("batch").alias("at")).orderBy("at")

    def open_changes(self) -> int:
        return self.rows("changes").count()

    def compact(self, at_least: int = 1) -> bool:
        """Fold the changes into the tables once there are ``at_least`` of them; whether it was done.

        The folded tables are a new batch, which takes the place of all earlier ones when it is committed.
        """
        if self.open_changes() < at_least:
            return False
        batch = self.new_batch()
        tables = ["discoveries", "embeddings", "scans", "counts"]
        self.put("discoveries", self.discoveries(), batch)
        self.put("embeddings", self.embeddings(), batch)
        self.put("scans", self.repos().withColumn("deleted", F.lit(False)), batch)
        self.put("counts", self.counts(), batch)
        self.commit(batch, tables, [*tables, "changes", "cleared", "dropped", "deleted_rules"])
        return True
