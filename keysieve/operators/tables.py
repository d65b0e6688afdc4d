"""Landed tables: partitioned parquet, appended to and replaced by partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.session import shared_dir

# A store of many repositories is cut by a hash of the url: a folder per url would
# mean millions of folders, most of them tiny.
BUCKETS = 64


def discovery_id(*more: str) -> Column:
    """A repeatable id: scanning the same line again yields the same id. ``more`` columns tell apart what the place in the
    repository doesn't, as the parent a commit was compared with."""
    return F.xxhash64("repo_url", "commit_id", "file_name", "line_number", "rule_id", *more)


def bucket(url: str = "repo_url") -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


def _bucketed(frame: DataFrame) -> DataFrame:
    # Rebalancing splits a bucket that one repository dominates over several files.
    return frame.withColumn("repo_bucket", bucket()).hint("rebalance", "repo_bucket")


def _staged_schema(frame: DataFrame) -> T.StructType:
    return T.StructType([*frame.schema.fields, T.StructField("repo_bucket", T.IntegerType())])


def append(frame: DataFrame, path: str) -> None:
    _bucketed(frame).write.mode("append").partitionBy("repo_bucket").parquet(path)


def append_new(frame: DataFrame, path: str) -> None:
    """Append the rows whose id is not stored yet, each id once; repeating a job adds nothing."""
    frame = frame.dropDuplicates(["id"])
    stored = read(frame.sparkSession, path)
    if stored is not None:
        frame = frame.join(stored.select("id"), "id", "left_anti").select(*frame.columns)
    append(frame, path)


def bucket_of(spark: SparkSession, repo_url: str) -> int:
    return spark.range(1).select(bucket_value(repo_url)).first()[0]


def bucket_value(repo_url: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(repo_url)), F.lit(BUCKETS)).cast("int")


def read(spark: SparkSession, path: str, repo_url: str | None = None) -> DataFrame | None:
    """A stored table, or None if nothing was written yet.

    Naming a repository prunes the scan to its folder.
    """
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    if repo_url is not None:
        stored = stored.filter((F.col("repo_bucket") == bucket_value(repo_url)) & (F.col("repo_url") == repo_url))
    return stored.drop("repo_bucket")


def replace(frame: DataFrame, path: str) -> None:
    """Replace a whole bucketed table by ``frame``, which may be derived from it."""
    _swap(frame, path, None)


def swap_repos(fresh: DataFrame, path: str, repos: DataFrame, without: Callable[[DataFrame], DataFrame]) -> None:
    """Put ``fresh``, each id once, in the place of all rows of the listed repositories (``url``).

    ``without`` takes the rows of those repositories out. Only the buckets of ``repos`` and ``fresh`` are rewritten.
    """
    fresh = fresh.dropDuplicates(["id"])
    if read(fresh.sparkSession, path) is None:
        append(fresh, path)
        return
    places = repos.select(bucket("url").alias("n")).union(fresh.select(bucket().alias("n"))).distinct()
    numbers = [row.n for row in places.collect()]
    stored = fresh.sparkSession.read.parquet(path).filter(F.col("repo_bucket").isin(numbers))
    kept = without(stored.select(*fresh.columns))
    _swap(kept.unionByName(fresh.join(kept.select("id"), "id", "left_anti").select(*fresh.columns)), path, numbers)


def _swap(frame: DataFrame, path: str, numbers: list[int] | None) -> None:
    """Replace the numbered buckets of a table, or all of them, by ``frame``, which may be derived from them.

    The new rows are complete in the scratch folder first. One job then puts them in the place of the old ones, which
    go when it commits: a failure before that leaves the table as it was. Buckets without a row left are emptied last.
    """
    spark = frame.sparkSession
    staging = shared_dir(spark, "staging")
    if numbers is None:
        numbers = [row[0] for row in spark.read.parquet(path).select("repo_bucket").distinct().collect()]
    _bucketed(frame).write.partitionBy("repo_bucket").parquet(staging)
    staged = spark.read.schema(_staged_schema(frame)).parquet(staging)
    filled = {row[0] for row in staged.select("repo_bucket").distinct().collect()}
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("repo_bucket").parquet(path))
    nothing = spark.createDataFrame([], frame.schema)
    for number in sorted(set(numbers) - filled):
        nothing.write.mode("overwrite").parquet(f"{path}/repo_bucket={number}")


def rewrite_bucket(spark: SparkSession, path: str, number: int,
                   change: Callable[[DataFrame], DataFrame]) -> None:
    """Apply a change to one bucket of a table and leave the others alone.

    The bucket's folder is overwritten even when no row is left in it.
    """
    folder = f"{path}/repo_bucket={number}"
    stored = spark.read.parquet(path)
    schema = T.StructType([f for f in stored.schema.fields if f.name != "repo_bucket"])
    rows = stored.filter(F.col("repo_bucket") == number).drop("repo_bucket")
    staging = shared_dir(spark, "staging")
    change(rows).select(*schema.fieldNames()).hint("rebalance").write.parquet(staging)
    spark.read.schema(schema).parquet(staging).write.mode("overwrite").parquet(folder)


def landed(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: later steps neither compute
    it again nor lose it with an executor."""
    path = shared_dir(frame.sparkSession, "landed")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def export_csv(frame: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled and line breaks stay inside their field."""
    (frame.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm").csv(path))


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm").csv(path))


def export_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)
