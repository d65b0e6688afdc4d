"""Two-pass external shuffle of records into shards of equal row counts.

Pass one scatters the records: every record draws a seeded hash of its place in the input, and the draw picks one of many
memory-sized buckets, so no key, source or group of copies can fill a bucket. Pass two takes one bucket a task, shuffles it
in memory by Fisher and Yates and writes it. The written buckets, one behind the other, are the shuffled order; the number
of rows in each gives every record its place in it, and shards are equal ranges of places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.llm.common import fresh, landed

# Bytes of text a bucket is meant to hold; a task keeps one bucket twice in memory, once in the old and once in the new order.
BUCKET_BYTES = 32 << 20


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0 to n - 1: from the end, each place swaps with one drawn from those up to it."""
    order = list(range(n))
    if n > 1:
        lasts = np.arange(n - 1, 0, -1)
        for last, drawn in zip(lasts.tolist(), rng.integers(0, lasts, endpoint=True).tolist()):
            order[last], order[drawn] = order[drawn], order[last]
    return np.array(order, dtype=np.int64)


def bucket_count(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """As many buckets as the strings and binaries of the rows fill (64 bytes a row for the rest), and no fewer than a
    shuffle has partitions, so that no task idles."""
    widths = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in rows.schema
              if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = sum(widths, F.lit(64)).cast("long")
    total = rows.select(width.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return max(-(-total // bucket_bytes), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shuffle_into_shards(rows: DataFrame, shards: int = 8, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, 2 ... within the shard), in uniformly random order.

    The counts of two shards differ by at most one row; with fewer rows than shards some stay empty, and an empty table
    gives no rows. Nulls in any column, empty and very long texts and repeated rows are records like others, each placed on
    its own: equal texts are not kept together. Input columns named ``shard`` or ``slot`` are replaced. The same seed
    over the same files, read in the same splits, gives the same order.

    A draw depends on the place of a record in its input split. ``rows`` should therefore be read from files, so that a
    task that runs again draws alike; land a frame that comes out of a shuffle first (``common.landed``).
    """
    rows = rows.drop("shard", "slot")
    draw, bucket, place = (fresh(n, rows.columns) for n in ("_draw", "_bucket", "_place"))
    buckets = bucket_count(rows, bucket_bytes)
    schema = T.StructType([*rows.schema, T.StructField(bucket, T.IntegerType()), T.StructField(place, T.LongType())])

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        draws = table.column(draw).to_numpy()
        which = table.column(bucket)[0].as_py()
        # In the order of the draws first, so that the order in which blocks arrive plays no part.
        order = np.argsort(draws, kind="stable")[fisher_yates(len(draws), np.random.default_rng([seed & (2**64 - 1), which]))]
        names = [n for n in table.column_names if n not in (draw, bucket)]
        table = table.select(names)
        # Slices of the new order keep the copies that are under way small.
        for at in range(0, len(order), 4096):
            part = table.take(pa.array(order[at:at + 4096]))
            part = part.append_column(bucket, pa.array(np.full(part.num_rows, which, dtype=np.int32)))
            part = part.append_column(place, pa.array(np.arange(at, at + part.num_rows)))
            yield from part.combine_chunks().to_batches()

    scattered = (rows.withColumn(draw, F.xxhash64(F.lit(seed).cast("long"), F.monotonically_increasing_id()))
                 .withColumn(bucket, F.pmod(F.col(draw), F.lit(buckets)).cast("int")))
    written = landed(scattered.repartitionById(buckets, F.col(bucket)).mapInArrow(shuffle, schema), "shuffled-buckets")
    # One row for each bucket, that is 16 bytes for every 32 MB of text.
    counts = sorted((r[0], r[1]) for r in written.groupBy(bucket).count().collect())
    firsts = np.concatenate([[0], np.cumsum([n for _, n in counts], dtype=np.int64)]).tolist()
    first = fresh("_first", written.columns)
    starts = rows.sparkSession.createDataFrame(
        [(b, at) for (b, _), at in zip(counts, firsts)], f"`{bucket}` int, `{first}` long")
    at, total = F.col(first) + F.col(place), F.lit(firsts[-1]).cast("long")
    return (written.join(starts, bucket)
            .withColumn("shard", _shard(at, total, shards).cast("int"))
            .withColumn("slot", at - _divided(F.col("shard").cast("long") * total, shards))
            .select(*rows.columns, "shard", "slot"))


def _divided(number: Column, divisor: int | Column) -> Column:
    """Whole-number division, exact for longs; a zero divisor, as an empty table has, gives null."""
    divisor = F.lit(divisor) if isinstance(divisor, int) else divisor
    return F.call_function("div", number, F.nullif(divisor.cast("long"), F.lit(0).cast("long")))


def _shard(at: Column, total: Column, shards: int) -> Column:
    """The shard s whose range, from s * total div shards on, holds the place."""
    return _divided((at + 1) * F.lit(shards).cast("long") - 1, total)


def write_shards(rows: DataFrame, path: str, shards: int = 8, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write shuffled shards as folders ``shard=0``, ``shard=1`` ... of parquet files; ``slot`` gives the order in a shard.

    A bucket touches few shards, so there are about as many files as buckets.
    """
    shuffle_into_shards(rows, shards, seed, bucket_bytes).write.partitionBy("shard").parquet(path)
