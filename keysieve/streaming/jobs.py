"""Continuous scans. A patch is numbered and matched inside its own row, so the batch
scan runs on a stream unchanged: no window, no state. Pairs seen and latest times can be
kept as keyed state, whose cost for a batch depends on the batch alone."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.plans.scans import scan_patches
from keysieve.schemas import DISCOVERIES, REPOS
from keysieve.sources.commits import PAIR

ARRIVING = T.StructType([T.StructField(c, T.StringType()) for c in ("repo_url", "commit_id", "file_name", "patch")])
PAIRS = T.StructType([T.StructField(c, T.StringType()) for c in PAIR] + [T.StructField("seen_at", T.TimestampType())])


def scan_patch_stream(spark: SparkSession, landed: str, target: str, progress: str, rules, files: int = 1000, **shape) -> None:
    """Scan all patches that have arrived in a folder since the last call; ``files`` bounds a micro-batch."""
    arriving = spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files).parquet(landed)
    running = (scan_patches(arriving, rules, **shape).writeStream.format("parquet")
               .option("path", target).option("checkpointLocation", progress)
               .trigger(availableNow=True).start())
    running.awaitTermination()


def pair_batch(batch: DataFrame, number: int, target: str) -> None:
    """Store the pairs of one micro-batch that no other batch has stored. A batch that is run again writes the same folder."""
    pairs = batch.groupBy(*PAIR).agg(F.min("seen_at").alias("seen_at"))
    if number:
        schema = T.StructType([*PAIRS.fields, T.StructField("batch", T.LongType())])
        earlier = batch.sparkSession.read.schema(schema).parquet(target).filter(F.col("batch") < number)
        known = [F.col(f"p.{c}").eqNullSafe(F.col(f"e.{c}")) for c in PAIR]
        pairs = pairs.alias("p").join(earlier.alias("e"), known, "left_anti")
    pairs.select(*PAIRS.fieldNames()).write.mode("overwrite").parquet(f"{target}/batch={number}")


def unique_pair_stream(spark: SparkSession, landed: str, target: str, progress: str, files: int = 1000) -> None:
    """Let every commit pair through once, however late it arrives; ``files`` bounds a micro-batch."""
    arriving = spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files).parquet(landed)
    running = (arriving.writeStream.foreachBatch(lambda batch, number: pair_batch(batch, number, target))
               .option("checkpointLocation", progress).trigger(availableNow=True).start())
    running.awaitTermination()


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk and, by the checkpoint, in the shared folder. A stream that goes
    on keeps the kind of store and the number of state partitions it was first started with."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ON_DISK)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def seen_pairs(arriving: DataFrame, forget: str | None = None) -> DataFrame:
    """Each pair once, on a stream or not. The pair is the key of the state, so a hot repository is spread by its commits.

    Without ``forget`` nothing is forgotten, however late a pair arrives again. With it (like "30 days") a pair leaves
    the state that long after its time, and pairs older than the watermark are dropped.
    """
    if forget is None:
        return arriving.dropDuplicates([*PAIR])
    return arriving.withWatermark("seen_at", forget).dropDuplicatesWithinWatermark([*PAIR])


def latest_batch(changed: DataFrame, number: int, target: str) -> None:
    """Store the repositories whose latest time a micro-batch may have moved. A batch that is run again writes the same folder."""
    changed.write.mode("overwrite").parquet(f"{target}/batch={number}")


def pair_state_stream(spark: SparkSession, landed: str, store: str, progress: str, files: int = 1000,
                      forget: str | None = None) -> None:
    """Let every commit pair through once and keep the latest time of every repository, both from keyed state.

    A batch looks up its own keys; what was stored earlier is not read again. ``files`` bounds a micro-batch.
    """
    arriving = spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files).parquet(landed)
    latest = arriving.groupBy(F.col("repo_url").alias("url")).agg(F.max(F.unix_timestamp("seen_at")).alias("last_scan"))
    with state_on_disk(spark):
        pairs = (seen_pairs(arriving, forget).writeStream.format("parquet").option("path", f"{store}/pairs")
                 .option("checkpointLocation", f"{progress}/pairs").trigger(availableNow=True).start())
        times = (latest.writeStream.outputMode("update").option("checkpointLocation", f"{progress}/scans")
                 .foreachBatch(lambda batch, number: latest_batch(batch, number, f"{store}/scans"))
                 .trigger(availableNow=True).start())
    for running in (pairs, times):
        running.awaitTermination()


def stored_pairs(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(PAIRS).parquet(f"{store}/pairs")


def stored_discoveries(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(DISCOVERIES).parquet(f"{store}/discoveries")


def stored_scan_times(spark: SparkSession, store: str) -> DataFrame:
    """(url, last_scan), the latest scan of every repository seen by the stream."""
    scans = spark.read.schema(REPOS).parquet(f"{store}/scans")
    return scans.groupBy("url").agg(F.max("last_scan").alias("last_scan"))


def store_batch(batch: DataFrame, number: int, store: str) -> None:
    """Store one micro-batch in folders of its own, first the discoveries, then the
    scan times that stand for them. A batch that is run again writes the same folders."""
    found = batch.persist()
    try:
        found.write.mode("overwrite").parquet(f"{store}/discoveries/batch={number}")
        times = found.groupBy(F.col("repo_url").alias("url")).agg(
            F.max(F.unix_timestamp("timestamp")).alias("last_scan"))
        times.write.mode("overwrite").parquet(f"{store}/scans/batch={number}")
    finally:
        found.unpersist()


def store_patch_stream(spark: SparkSession, landed: str, store: str, progress: str, rules, files: int = 1000, **shape) -> None:
    """Scan arriving patches into a store of discoveries and scan times; ``files`` bounds a micro-batch.

    Scan times are an append-only log whose maximum is ``last_scan``: nothing is
    updated in place, so a lost executor or a replayed batch cannot move it back.
    """
    arriving = spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files).parquet(landed)
    running = (scan_patches(arriving, rules, **shape).writeStream
               .foreachBatch(lambda batch, number: store_batch(batch, number, store))
               .option("checkpointLocation", progress).trigger(availableNow=True).start())
    running.awaitTermination()
