"""Cosine search for many requests at once: signs of random projections, several probes a table, exact recheck.

A vector's key in a table is the pattern of signs of ``bits`` random projections. A request looks into the buckets of all
patterns within ``flips`` signs of its own, in every table; what it meets there is compared exactly. The number of tables
follows from the recall asked for at the threshold, the number of bits from the number of vectors, so that a bucket of
unrelated vectors stays small at every size.

Most of what shares a bucket is still unrelated. So keys carry the signs of all tables and of 64 more projections, and only
pairs that differ in few of the 64 and in few of all are compared, before any vector is moved; a pair at the threshold
differs in more of either with a hundredth of the probability that all tables miss it. The signs of all tables also tell
in which table a pair meets first, so it leaves the join once.

What is left is compared in cells: a block of requests and a block of classes. A vector moves once into each cell in which it
has pairs, not once for each pair, so what is moved doesn't grow with the square of a crowd of near vectors.

Equal vectors are one class: only classes are hashed, met and compared, members are joined to the result, those of large
classes in parts. Buckets that many near vectors share are split into parts, each of which meets the probes in a task of
its own.

Left out, as they are similar to nothing: null ids, vectors that are null, of another length, without length, or hold
null or non-finite entries. Repeated rows and ids are members of their classes as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.operators.similarity import THRESHOLD
from keysieve.operators.skew import salted_join, spread
from keysieve.operators.tables import landed


@dataclass(frozen=True)
class Shape:
    dimensions: int
    threshold: float
    bits: int
    tables: int
    flips: int = 2
    seed: int = 11
    differing: int = 64     # of the 64 signs of a sketch
    differing_all: int = 2 ** 31 - 1    # of these and the signs of all tables

    @property
    def tables_a_word(self) -> int:
        return 64 // self.bits

    @property
    def words(self) -> int:
        """How many numbers of 64 bits hold the keys of a vector in all tables."""
        return -(-self.tables // self.tables_a_word)

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(self.dimensions, self.tables * self.bits))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """The sign pattern of each vector in each table."""
        signs = (vectors @ self.planes() > 0).reshape(len(vectors), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))

    def sketches(self, vectors: np.ndarray) -> np.ndarray:
        """The signs of 64 projections apart from those of the tables, as one number."""
        planes = np.random.default_rng([self.seed, 1]).normal(size=(self.dimensions, 64))
        return np.packbits(vectors @ planes > 0, axis=1).view(">i8")[:, 0].astype(np.int64)

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        """The keys of each vector in all tables, ``tables_a_word`` of them in a number."""
        keys, packed = self.keys(vectors), np.zeros((self.words, len(vectors)), dtype=np.int64)
        for t in range(self.tables):
            packed[t // self.tables_a_word] |= keys[:, t] << (t % self.tables_a_word * self.bits)
        return packed

    def key(self, words: list[Column], table_no: int) -> Column:
        """The key in one table, or what two keys differ in, out of such numbers."""
        shifted = F.shiftrightunsigned(words[table_no // self.tables_a_word], table_no % self.tables_a_word * self.bits)
        return shifted.bitwiseAND(F.lit((1 << self.bits) - 1))

    def masks(self) -> np.ndarray:
        """What to flip for each probe."""
        return np.array([sum(1 << b for b in some) for n in range(min(self.flips, self.bits) + 1)
                         for some in combinations(range(self.bits), n)], dtype=np.int64)


def _most_differing(signs: int, differ: float, odds: float) -> int:
    """The number of differing signs that is exceeded with a probability of at most ``odds``."""
    def log(x: float, times: int) -> float:
        return 0.0 if not times else times * math.log(x) if x > 0 else -math.inf
    tail = 0.0
    for n in range(signs, 0, -1):
        ways = math.lgamma(signs + 1) - math.lgamma(n + 1) - math.lgamma(signs - n + 1)
        tail += math.exp(ways + log(differ, n) + log(1 - differ, signs - n))
        if tail > odds:
            return n
    return 0


def shape_for(rows: int, dimensions: int, threshold: float = THRESHOLD, recall: float = 0.999999, bucket_rows: int = 64,
              flips: int = 2) -> Shape:
    """Enough tables that a pair at the threshold is missed by all of them with probability at most 1 - ``recall``."""
    bits = min(max(math.ceil(math.log2(max(rows, 1) / bucket_rows)), 8), 48)
    differ = math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    met = sum(math.comb(bits, n) * differ ** n * (1 - differ) ** (bits - n) for n in range(flips + 1))
    tables = 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))
    differing, differing_all = (_most_differing(n, differ, (1 - recall) / 100) for n in (64, 64 + tables * bits))
    return Shape(dimensions, threshold, bits, tables, flips, differing=differing, differing_all=differing_all)


def _classed(rows: DataFrame, id_column: str, vector: str, dimensions: int) -> DataFrame:
    """(id, class, vector) of the rows that can be similar to anything."""
    wide = rows.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = wide.filter(F.col("id").isNotNull() & (F.size("vector") == dimensions) & finite
                         & F.exists("vector", lambda x: x != 0))
    return usable.select("id", F.unhex(F.md5(F.to_json("vector"))).alias("class"), "vector")


def _one_each(classed: DataFrame) -> DataFrame:
    return classed.groupBy("class").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"))


def _matrix(vectors: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _signed(classes: DataFrame, shape: Shape) -> DataFrame:
    """(class, sketch, k0, k1 ...): the sketch and the packed keys of a class."""
    names = ["class", "sketch", *[f"k{i}" for i in range(shape.words)]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                vectors = _matrix(some.column("vector"), shape.dimensions)
                numbers = [shape.sketches(vectors), *shape.packed(vectors)]
                yield pa.RecordBatch.from_arrays([some.column("class"), *map(pa.array, numbers)], names)

    return classes.select("class", "vector").mapInArrow(rows, "class binary, " + ", ".join(f"{n} long" for n in names[1:]))


def _in_tables(signed: DataFrame, shape: Shape) -> DataFrame:
    """With (table_no, bucket): a row for every table."""
    words = [F.col(f"k{i}") for i in range(shape.words)]
    buckets = F.array(*[shape.key(words, t) for t in range(shape.tables)])
    return signed.select("*", F.posexplode(buckets).alias("table_no", "bucket"))


def _probed(signed: DataFrame, shape: Shape) -> DataFrame:
    """(request_class, asked, a0, a1 ..., table_no, bucket): all places a request looks at."""
    named = {"class": "request_class", "sketch": "asked"} | {f"k{i}": f"a{i}" for i in range(shape.words)}
    masks = F.explode(F.array(*[F.lit(int(m)) for m in shape.masks()]).cast("array<long>"))
    return (_in_tables(signed, shape).withColumnsRenamed(named).withColumn("mask", masks)
            .withColumn("bucket", F.col("bucket").bitwiseXOR(F.col("mask"))).drop("mask"))


def _near(shape: Shape) -> Column:
    """Whether a pair that meets in a table differs in few signs and meets in no table before."""
    apart = F.bit_count(F.col("sketch").bitwiseXOR(F.col("asked")))
    words = [F.col(f"k{i}").bitwiseXOR(F.col(f"a{i}")) for i in range(shape.words)]
    in_all = reduce(lambda x, y: x + y, [F.bit_count(w) for w in words], apart)
    before = [(F.col("table_no") > t) & (F.bit_count(shape.key(words, t)) <= shape.flips) for t in range(shape.tables - 1)]
    first = ~reduce(lambda x, y: x | y, before) if before else F.lit(True)
    return (apart <= shape.differing) & (in_all <= shape.differing_all) & first


def _block(name: str, rows: int) -> Column:
    """Blocks of about 4096 of ``rows`` distinct values."""
    return F.pmod(F.xxhash64(name), F.lit(max(-(-rows // 4096), 1)))


def _cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosine of row i of ``x`` and row j of ``y`` for each pair (i, j)."""
    found = np.empty(len(i))
    for at in range(0, len(i), 8192):
        some = slice(at, at + 8192)
        # Scaled first, so entries of any size neither overflow nor vanish.
        a, b = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x[i[some]], y[j[some]]))
        lengths = np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
        found[some] = np.einsum("ij,ij->i", a, b) / lengths
    return found


class VectorIndex:
    """An index written once: classes with their vectors, members, keys in parts, and the buckets that have several parts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.shape = Shape(**spark.read.parquet(f"{path}/shape").first().asDict())

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def build(cls, rows: DataFrame, path: str, dimensions: int, id_column: str = "id", vector: str = "embedding",
              threshold: float = THRESHOLD, recall: float = 0.999999, bucket_rows: int = 64, part_rows: int = 10_000) -> VectorIndex:
        spark = rows.sparkSession
        classed = _classed(rows, id_column, vector, dimensions)
        split = F.ceil(F.col("copies") / part_rows).cast("int").alias("parts")
        _one_each(classed).select("class", "vector", split).write.parquet(f"{path}/classes")
        classes = spark.read.parquet(f"{path}/classes")
        part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int").alias("part")
        crowded = classes.filter(F.col("parts") > 1).select("class", "parts")
        (salted_join(classed.select("class", "id"), crowded, ["class"], F.col("id"), how="left").select("class", "id", part)
         .write.parquet(f"{path}/members"))
        shape = shape_for(classes.count(), dimensions, threshold, recall, bucket_rows)
        _signed(classes, shape).write.parquet(f"{path}/signs")
        signs = spark.read.parquet(f"{path}/signs")
        keys = _in_tables(signs, shape).select("class", "table_no", "bucket")
        (keys.groupBy("table_no", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > part_rows)
         .select("table_no", "bucket", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")).write.parquet(f"{path}/large"))
        large = spark.read.parquet(f"{path}/large")
        # Only the tables in which a class is in a crowded bucket are named.
        splits = (salted_join(keys, large, ["table_no", "bucket"], F.col("class")).groupBy("class")
                  .agg(F.map_from_entries(F.collect_list(F.struct("table_no", "parts"))).alias("splits")))
        signs.join(splits, "class", "left").write.parquet(f"{path}/keys")
        # Written last: an index without it was not finished.
        spark.createDataFrame([asdict(shape)], "dimensions int, threshold double, bits int, tables int, flips int, seed int, differing int, differing_all int"
                              ).coalesce(1).write.parquet(f"{path}/shape")
        return cls(spark, path)

    def _requests(self, requests: DataFrame, id_column: str, vector: str) -> DataFrame:
        return _classed(requests, id_column, vector, self.shape.dimensions)

    def _met(self, wanted: DataFrame) -> DataFrame:
        """(request_class, class): the pairs that the index leaves to be compared, each once."""
        shape = self.shape
        split = F.try_element_at("splits", F.col("table_no"))
        stored = (_in_tables(self._read("keys"), shape)
                  .withColumn("part", F.coalesce(F.pmod(F.xxhash64("class"), split), F.lit(0)).cast("int")).drop("splits"))
        probes = (_probed(_signed(spread(wanted), shape), shape)
                  .join(self._read("large"), ["table_no", "bucket"], "left")
                  .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts"))
        # Spark takes the probes for as small as the requests they come from; without the hint they are broadcast.
        return probes.hint("merge").join(stored, ["table_no", "bucket", "part"]).filter(_near(shape)).select("request_class", "class")

    def similar_classes(self, wanted: DataFrame, threshold: float | None = None) -> DataFrame:
        """(request_class, class, parts, similarity) above the threshold, for ``wanted`` (class, vector), one row for each
        class in a table that was landed; in ``parts`` parts are the members of the class."""
        least = self.shape.threshold if threshold is None else threshold
        if least < self.shape.threshold:
            raise ValueError(f"the index was built for similarities above {self.shape.threshold}")
        classes, dimensions = self._read("classes"), self.shape.dimensions
        met = landed(self._met(wanted))     # the vectors of both sides are looked up
        rows, columns = wanted.count(), classes.count()

        def cells(*more: Column) -> DataFrame:
            return met.select(_block("request_class", rows).alias("row"), _block("class", columns).alias("column"), *more)

        stored = cells(F.col("class").alias("class")).distinct().join(classes.hint("merge"), "class")
        targets = cells(F.col("request_class").alias("class")).distinct().join(wanted.hint("merge"), "class")
        both = (stored.select("row", "column", "class", "parts", "vector")
                .union(targets.select("row", "column", "class", F.lit(0).alias("parts"), "vector"))).groupBy("row", "column")

        def compare(pairs: pa.Table, both: pa.Table) -> pa.Table:
            asked = pc.equal(both["parts"], 0)
            x, y = both.filter(asked), both.filter(pc.invert(asked))
            i, j = (pc.index_in(pairs[name], value_set=side["class"].combine_chunks()).to_numpy()
                    for name, side in (("request_class", x), ("class", y)))
            u, v = (_matrix(side["vector"], dimensions) for side in (x, y))
            score = _cosines(v, u, j, i)
            kept = np.flatnonzero(score > least)
            return pa.table({"request_class": pairs["request_class"].take(kept), "class": pairs["class"].take(kept),
                             "parts": y["parts"].take(j[kept]), "similarity": score[kept]})

        pairs = cells(*[F.col(c).alias(c) for c in ("request_class", "class")]).groupBy("row", "column")
        return (pairs.cogroup(both)
                .applyInArrow(compare, "request_class binary, class binary, parts int, similarity double"))

    def similar(self, requests: DataFrame, id_column: str = "id", vector: str = "embedding",
                threshold: float | None = None) -> DataFrame:
        """(request_id, id, similarity): every request with every stored row above the threshold, itself included."""
        asked = self._requests(requests, id_column, vector)
        pairs = self.similar_classes(landed(_one_each(asked).select("class", "vector")), threshold)
        pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        named = asked.select(F.col("id").alias("request_id"), F.col("class").alias("request_class"))
        met = self._read("members").hint("merge").join(pairs, ["class", "part"])
        return (salted_join(met, named, ["request_class"], F.col("id"), salts=8, hint="merge")
                .select("request_id", "id", "similarity"))

    def exact_classes(self, wanted: DataFrame, threshold: float | None = None, block: int = 16_000) -> DataFrame:
        """(request_class, class, similarity) without the index: every request with every class, requests in blocks that fit
        a task. For measuring recall."""
        least = self.shape.threshold if threshold is None else threshold
        schema, dimensions = "request_class binary, class binary, similarity double", self.shape.dimensions
        classes = self._read("classes").select("class", "vector")

        def unit(vectors: np.ndarray) -> np.ndarray:
            scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
            return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)

        def compare(names: pa.Array, targets: np.ndarray) -> DataFrame:
            step = max(2_000_000 // len(targets), 1)

            def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                across = unit(targets).T
                for batch in batches:
                    for at in range(0, len(batch), step):
                        some = batch.slice(at, step)
                        vectors = _matrix(some.column("vector"), dimensions)
                        # Single precision errs by less than a tenth of this; what passes is compared in double precision.
                        i, j = np.nonzero(unit(vectors) @ across > least - 1e-6 * dimensions)
                        score = _cosines(vectors, targets, i, j)
                        i, j, score = (x[score > least] for x in (i, j, score))
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), some.column("class").take(pa.array(i)),
                                                          pa.array(score)], ["request_class", "class", "similarity"])
            return classes.mapInArrow(pairs, schema)

        blocks = max(-(-wanted.count() // block), 1)
        found = []
        for b in range(blocks):
            rows = wanted.select("class", "vector").filter(F.pmod(F.xxhash64("class"), F.lit(blocks)) == b).toArrow()
            if len(rows):
                found.append(compare(rows["class"].combine_chunks(), _matrix(rows["vector"], dimensions)))
        return reduce(DataFrame.union, found) if found else self.spark.createDataFrame([], schema)

    def recall(self, requests: DataFrame, id_column: str = "id", vector: str = "embedding",
               threshold: float | None = None) -> DataFrame:
        """(request_id, similar, found): how many classes are similar to each request, and how many of them the index finds."""
        asked = self._requests(requests, id_column, vector)
        wanted = landed(_one_each(asked).select("class", "vector"))
        exact = self.exact_classes(wanted, threshold).groupBy("request_class").agg(F.count("*").alias("similar"))
        found = self.similar_classes(wanted, threshold).groupBy("request_class").agg(F.count("*").alias("found"))
        named = asked.select(F.col("id").alias("request_id"), F.col("class").alias("request_class"))
        return (named.join(exact, "request_class", "left").join(found, "request_class", "left")
                .select("request_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("similar", "found")]))
