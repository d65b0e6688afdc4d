"""Substring search over stored texts by an index of trigrams.

Rows are dealt into parts of bounded size. A part's file lists, for every trigram in its rows, the ids of the rows that hold
it, in the order of trigrams, so that a reader skips all pages but those of the trigrams it asks for. A search takes
the rarest trigrams of the pattern, intersects their lists part by part and looks at the rows that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_ROWS = 50_000
BLOCK_ROWS = 2000         # rows whose trigrams are sorted at once
RAREST = 3                # how many trigrams of a pattern are intersected
_POSTINGS = "part int, gram string, n int, ids array<long>"


def _grams(text: str) -> set[str]:
    return {text[i:i + 3] for i in range(len(text) - 2)}


class SearchIndex:
    """An index below ``path`` over rows with an ``id`` that tells them apart and a ``text``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, rows: DataFrame, path: str, id: str = "id", text: str = "text", part_rows: int = PART_ROWS) -> SearchIndex:
        """Write the rows and their index. Rows without an id or a text are in no result and left out."""
        index = cls(rows.sparkSession, path)
        rows = rows.filter(F.col(id).isNotNull() & F.col(text).isNotNull())
        parts = rows.count() // part_rows + 1
        part = F.pmod(F.xxhash64(F.lit(7), F.col(id)), F.lit(parts)).cast("int")
        kept = rows.select(part.alias("part"), F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
        kept.repartition("part").sortWithinPartitions("part", "id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
        stored = index.rows()
        # One part after the other, each in the order of its trigrams.
        lists = stored.repartition("part").sortWithinPartitions("part", "id").mapInArrow(_postings, _POSTINGS)
        lists.write.mode("overwrite").option("parquet.page.row.count.limit", 2000).parquet(f"{path}/postings")
        return index

    def rows(self) -> DataFrame:
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("part", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")

    def candidates(self, pattern: str) -> DataFrame:
        """(part, id) of the rows that hold the rarest trigrams of a pattern of three characters or more."""
        grams = sorted(_grams(pattern))
        counts = {r.gram: r.n for r in self.postings().filter(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        rarest = sorted(grams, key=lambda g: counts.get(g, 0))[:RAREST]
        if not all(g in counts for g in rarest):
            return self.spark.createDataFrame([], "part int, id long")
        lists = (self.postings().filter(F.col("gram").isin(rarest)).groupBy("part").agg(F.collect_list("ids").alias("lists"))
                 .filter(F.size("lists") == len(rarest)))
        common = F.aggregate(F.slice("lists", 2, RAREST), F.get("lists", F.lit(0)), F.array_intersect)
        return lists.select("part", F.explode(common).alias("id"))

    def search(self, pattern: str) -> DataFrame:
        """(id, text) of the rows whose text contains the pattern, as it is written. The empty pattern is in every text.

        Patterns below three characters have no trigram and are looked for in all rows.
        """
        rows = self.rows()
        if len(pattern) >= 3:
            rows = rows.join(self.candidates(pattern), ["part", "id"], "left_semi")
        return rows.filter(F.contains(F.col("text"), F.lit(pattern))).select("id", "text")


def _gram_rows(texts: list[str], first: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row): every trigram of every text once, grams as 63-bit numbers that sort as their texts do; rows from ``first`` on."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if not len(points):
        return points, points
    # Numbered by the characters that occur here, a gram and its row are one number and one sort is enough.
    used = np.flatnonzero(np.bincount(points))
    place = np.zeros(used[-1] + 1, dtype=np.int64)
    place[used] = np.arange(len(used))
    points, base = place[points], len(used)
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = row[:-2] == row[2:]
    gram = ((points[:-2] * base + points[1:-1]) * base + points[2:])[inside]
    gram, row = np.divmod(np.unique(gram * len(texts) + row[:-2][inside]), len(texts))
    return used[gram // base ** 2] << 42 | used[gram // base % base] << 21 | used[gram % base], row + first


def _gram_texts(grams: np.ndarray) -> list[str]:
    points = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype("<u4")
    joined = points.tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[i:i + 3] for i in range(0, len(joined), 3)]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("gram", pa.string()), ("n", pa.int32()), ("ids", pa.list_(pa.int64()))])
    here, ids, found = None, [], []

    def finished() -> Iterator[pa.RecordBatch]:
        if not found:
            return
        gram, row = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(gram, kind="stable")
        gram, keys = gram[order], np.concatenate(ids)[row[order]]
        starts = np.flatnonzero(np.diff(gram, prepend=-1))
        ends = np.append(starts[1:], len(gram))
        for at in range(0, len(starts), 5000):
            a, b = starts[at:at + 5000], ends[at:at + 5000]
            lists = pa.ListArray.from_arrays(pa.array(np.append(a, b[-1]) - a[0], pa.int32()), pa.array(keys[a[0]:b[-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([here] * len(a), pa.int32()), pa.array(_gram_texts(gram[a]), pa.string()),
                                              pa.array(b - a, pa.int32()), lists], schema=schema)

    for batch in batches:
        key, text, part = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "text", "part"))
        part = part.to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for begin, end in zip(edges, edges[1:]):
            if end > begin and part[begin] != here:
                yield from finished()
                here, ids, found = int(part[begin]), [], []
            for at in range(begin, end, BLOCK_ROWS):
                some = slice(at, min(at + BLOCK_ROWS, end))
                found.append(_gram_rows(text[some].to_pylist(), sum(map(len, ids))))
                ids.append(key[some].to_numpy(zero_copy_only=False))
    yield from finished()
