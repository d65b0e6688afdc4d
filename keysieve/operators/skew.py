"""Helpers that keep one hot key from becoming one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dense_positions(frame: DataFrame, keys: Sequence[str], order: str, block: int = 50_000,
                    name: str = "pos") -> DataFrame:
    """Number the rows of every key 0, 1, 2 ... by a descending integer column that is
    unique within the key.

    The order column is cut into ranges of ``block`` values. Row numbers are taken
    inside a range, which holds at most ``block`` rows, and shifted by the number of
    rows in later ranges, of which there is one summary row each.
    """
    ranged = frame.withColumn("_range", F.floor(F.col(order) / block))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    later = W.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(*keys, "_range", F.coalesce(F.sum("_rows").over(later), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(F.desc(order)))
    return (ranged.withColumn("_inside", inside)
            .join(shifts, [*keys, "_range"])
            .withColumn(name, F.col("_shift") + F.col("_inside") - 1)
            .drop("_range", "_inside", "_shift"))


def spread(table: DataFrame) -> DataFrame:
    """Spread a table just read over the cores, if its files make fewer splits than that.

    A table of many files is left as it is; only an input too small to occupy the
    cluster, such as one file with a single row group, is dealt out anew.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    # The condition always holds. It is not deterministic, so costly conditions on the
    # text stay above it instead of moving below the exchange into the few tasks.
    return table.repartition(cores).filter(F.spark_partition_id() >= 0)


def salted_join(large: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column,
                salts: int = 32, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Equi-join that spreads every key of ``large`` over ``salts`` tasks.

    The small side is repeated once per salt, so it should hold few rows per key. Spark doesn't count the repeats when it
    weighs a broadcast; the ``hint`` "merge" rules one out for a small side that grows with the input.
    """
    left = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint(hint) if hint else right, [*keys, "_salt"], how).drop("_salt")


def is_small(frame: DataFrame, rows: int = 5000, characters: int = 8_000_000) -> bool:
    """Whether a frame is proven to fit a broadcast; looks at no more than ``rows`` + 1 rows."""
    widths = frame.select(F.length(F.to_json(F.struct("*"))).alias("n")).limit(rows + 1)
    count, total = widths.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return count <= rows and total <= characters


def lookup_join(large: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "left") -> DataFrame:
    """Join with a lookup table of few, often used keys: broadcast if it is proven to be
    small, salted otherwise."""
    if is_small(small):
        return large.join(F.broadcast(small), key, how)
    return salted_join(large, small, [key], spread, how=how)


def with_parts(frame: DataFrame, keys: Sequence[str], spread: str, part_rows: int) -> DataFrame:
    """Add ``part``: 0 for groups of up to ``part_rows`` rows, several values for larger
    ones, so that (keys, part) can be collected into an array of bounded size.

    Only the hashes of oversized groups are joined back, salted, since it is their
    rows that would otherwise meet in one task. Two groups that share a hash are
    counted together, which can only split them further.
    """
    hashed = frame.withColumn("_group", F.xxhash64(*keys))
    oversized = (hashed.groupBy("_group").agg(F.count("*").alias("_size")).filter(F.col("_size") > part_rows)
                 .select("_group", F.ceil(F.col("_size") / part_rows).cast("int").alias("_parts")))
    joined = salted_join(hashed, oversized, ["_group"], F.col(spread), how="left")
    part = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(F.col(spread), F.lit("part")), F.col("_parts")).cast("int"))
    return joined.select(*frame.columns, part.alias("part"))
