"""Pages deep inside an ordered result, each read from the ranges it lies in.

The result is cut once into ranges of its order, and rows are numbered inside a range. The sizes of the ranges give the place
where each begins, so a page of any depth reads one range or two instead of sorting everything before it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

RANGE_ROWS = 100_000


class PageIndex:
    """An ordered result below ``path``. ``starts`` has the places, from 1, where ranges begin: a number for every range."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.columns = spark, path, schema.fieldNames()
        self.schema = T.StructType([*schema, T.StructField("_at", T.IntegerType()), T.StructField("_range", T.IntegerType())])
        self.ranges, self.starts, self.total = [], [], 0
        for row in self._rows().groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
            self.ranges.append(row["_range"])
            self.starts.append(self.total + 1)
            self.total += row["n"]

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    @classmethod
    def build(cls, rows: DataFrame, path: str, order: Sequence[Column], range_rows: int = RANGE_ROWS) -> PageIndex:
        """``order`` has to tell all rows apart, or rows that are alike may fall to either of their places."""
        count = rows.count() // range_rows + 1
        dealt = rows.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id())
        # A range is one partition already, in which the window sorts and numbers.
        numbered = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
        numbered.write.mode("overwrite").partitionBy("_range").parquet(path)
        return cls(rows.sparkSession, path, rows.schema)

    def _placed(self, ranges: Sequence[int]) -> DataFrame:
        first = F.create_map(*[F.lit(x) for r in ranges for x in (self.ranges[r], self.starts[r])])
        rows = self._rows().filter(F.col("_range").isin([self.ranges[r] for r in ranges]))
        return rows.select((first[F.col("_range")] + F.col("_at") - 1).cast("long").alias("place"), *self.columns)

    def page(self, after: int, limit: int) -> DataFrame:
        """The ``limit`` rows behind place ``after`` (0: from the start), in order, with their ``place``. The last place of a
        page is the token of the next one."""
        if limit < 1 or after < 0:
            raise ValueError("a page holds at least one row and begins at or behind the start")
        last = min(after + limit, self.total)
        if after >= last:
            return self._rows().limit(0).select(F.lit(0).cast("long").alias("place"), *self.columns)
        ranges = range(bisect_right(self.starts, after + 1) - 1, bisect_right(self.starts, last))
        return self._placed(ranges).filter(F.col("place").between(after + 1, last)).orderBy("place")

    def all_rows(self) -> DataFrame:
        """Every row with its place, as walking all pages would give them."""
        sizes = self.spark.createDataFrame(list(zip(self.ranges, self.starts)), "_range int, _start long")
        rows = self._rows().join(sizes, "_range")
        return rows.select((F.col("_start") + F.col("_at") - 1).alias("place"), *self.columns)
