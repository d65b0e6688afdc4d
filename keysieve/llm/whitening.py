"""Whitening of embeddings by a bidiagonal qd solver.

Three passes over the vectors, none of which shuffles one: exact sums for the means; QR of the centred rows, block by block
inside a task and then up a tree of tasks; and the covariance of the whitened vectors, which says how far it is from
the identity. The triangle that is left has the dimension of the vectors; ``bidiagonal`` takes its singular values and
right vectors, from which whitening follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.llm.bidiagonal import right_vectors
from keysieve.llm.common import landed

SCALE, OFFSET = 64, 1_000_000
LIMIT = 2 ** 52        # entries beyond this, once scaled, count as this
SAFE = 2 ** 62


@dataclass
class Whitening:
    """What was fitted: ``axes`` is dimension x components, already divided by the square roots of the eigenvalues."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    explained: list[float] = field(default_factory=list)
    identity_error: float | None = None


def whole_numbers(column: pa.Array, dimension: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows that count and their vectors as integers floor(64 * c) + 1000000, for each length there is (or the one given).

    A vector counts if neither it nor an entry is null and all entries are finite.
    """
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for d in [dimension] if dimension is not None else [int(x) for x in np.unique(lengths) if x > 0]:
        rows = np.flatnonzero(lengths == d)
        entries = flat[starts[rows, None] + np.arange(d)]
        fine = np.isfinite(entries).all(axis=1)
        with np.errstate(over="ignore"):
            scaled = np.clip(np.floor(SCALE * entries[fine]), -LIMIT, LIMIT)
        yield rows[fine], scaled.astype(np.int64) + OFFSET


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S without rounding: as longs, or as Python integers where a long might not hold them."""
    top = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    kind = np.int64 if top < SAFE else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def _squares(dev: np.ndarray) -> pa.Array:
    """The exact sum of squares of each row; null if it has more than 38 digits."""
    if dev.dtype == np.int64 and dev.shape[1] * int(np.abs(dev).max(initial=0)) ** 2 < SAFE:
        return pa.array((dev * dev).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = [sum(int(v) ** 2 for v in row) for row in dev]
    return pa.array([v if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))


def folded(parts: DataFrame, merge: Callable[[list[bytes]], bytes], size: int) -> list[bytes]:
    """Merge (part, state) rows, one for each task, up a tree of tasks until few enough are left for the driver.

    A task merges at most 16 states, fewer if they are large.
    """
    width = int(max(2, min(16, (64 << 20) // max(size, 1))))
    unite = F.pandas_udf(lambda lists: pd.Series([merge(list(states)) for states in lists]), T.BinaryType())
    level = landed(parts, "whitening")
    while level.count() > width:
        grouped = level.groupBy(F.floor(F.col("part") / width).alias("part")).agg(F.collect_list("state").alias("states"))
        level = landed(grouped.select("part", unite("states").alias("state")), "whitening")
    return [bytes(r["state"]) for r in level.orderBy("part").collect()]


def _triangle(states: list[bytes], d: int) -> np.ndarray:
    return np.linalg.qr(np.vstack([np.frombuffer(s).reshape(-1, d) for s in states]), mode="r")


def _moments(states: list[bytes], k: int) -> np.ndarray:
    """Count, mean and centred products of the union of several sets, from those of each; one flat array."""
    total = np.zeros(1 + k + k * k)
    for state in states:
        other = np.frombuffer(state)
        n, m = total[0], other[0]
        if m:
            gap = other[1:1 + k] - total[1:1 + k]
            total[1 + k:] += other[1 + k:] + (np.outer(gap, gap) * (n * m / (n + m))).ravel()
            total[1:1 + k] += gap * (m / (n + m))
            total[0] = n + m
    return total


def fit(rows: DataFrame, vector: str = "embedding", components: int = 32) -> Whitening:
    """Fit the whitening of a column of vectors.

    Vectors count if they are not null, hold no null or non-finite entry, and have the length that most such vectors have
    (of several such lengths the largest); repeated vectors count each time. Directions without variance (constant
    vectors, fewer vectors than dimensions) have no component. An empty table gives a model without components.
    """
    vectors = rows.select(F.col(vector).cast("array<double>").alias("v"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                # High and low halves, so that neither sum can overflow.
                new = np.vstack([np.full(x.shape[1], len(x)), (x >> 26).sum(axis=0), (x & (2 ** 26 - 1)).sum(axis=0)])
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + new
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), *map(pa.array, s)],
                                             names=["d", "at", "n", "high", "low"])

    sums = landed(vectors.mapInArrow(add_up, "d long, at long, n long, high long, low long").groupBy("d", "at")
                  .agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]), "whitening")
    first = sums.filter("at = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if first is None or not first["n"]:
        return Whitening()
    d, n = first["d"], first["n"]
    exact = [r["high"] * 2 ** 26 + r["low"] for r in sums.filter(F.col("d") == d).orderBy("at").collect()]
    model = Whitening(n, exact)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = np.zeros((0, d))
        for batch in batches:
            for _, x in whole_numbers(batch.column(0), d):
                if len(x):
                    triangle = np.linalg.qr(np.vstack([triangle, deviations(x, n, exact).astype(float) / n]), mode="r")
        if len(triangle):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([triangle.tobytes()], pa.binary())], names=["part", "state"])

    states = folded(vectors.mapInArrow(factor, "part long, state binary"), lambda s: _triangle(s, d).tobytes(), 8 * d * d)
    triangle = np.zeros((d, d))
    r = _triangle(states, d)
    triangle[:len(r)] = r
    values, directions = right_vectors(triangle, components)
    k = len(values)
    model.axes = directions / (values / np.sqrt(n)) if k else np.zeros((d, 0))
    model.explained = (values ** 2 / (triangle ** 2).sum()).tolist() if k else []
    if not k:
        return model
    axes = model.axes

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            for _, x in whole_numbers(batch.column(0), d):
                if len(x):
                    y = (deviations(x, n, exact).astype(float) / n) @ axes
                    centred = y - y.mean(axis=0)
                    block = np.concatenate([[len(y)], y.mean(axis=0), (centred.T @ centred).ravel()])
                    total = _moments([total.tobytes(), block.tobytes()], k)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                          pa.array([total.tobytes()], pa.binary())], names=["part", "state"])

    states = folded(vectors.mapInArrow(measure, "part long, state binary"), lambda s: _moments(s, k).tobytes(), 8 * k * k)
    covariance = _moments(states, k)[1 + k:].reshape(k, k) / n
    model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows whose vector counts (see ``fit``), with ``deviation`` decimal(38, 0), the exact sum of (n * x - S)^2, null
    beyond 38 digits, and ``whitened``, an array with one entry for each component.

    Input columns named ``deviation`` or ``whitened`` are replaced; nulls in other columns stay. Rows whose vector does not
    count, and all rows if none does, are left out.
    """
    rows = rows.drop("deviation", "whitened")
    schema = T.StructType([*rows.schema, T.StructField("deviation", T.DecimalType(38, 0)),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    d, n, sums, axes = len(model.sums), model.n, model.sums, model.axes
    k = axes.shape[1]
    if not d:
        return rows.sparkSession.createDataFrame([], schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole_numbers(batch.column(batch.schema.get_field_index(vector)), d):
                dev = deviations(x, n, sums)
                y = (dev.astype(float) / n) @ axes
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, len(y) * k + 1, k, dtype=np.int32) if k else
                                                             np.zeros(len(y) + 1, dtype=np.int32)), pa.array(y.ravel()))
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, _squares(dev), whitened], names=schema.names)

    return rows.mapInArrow(project, schema)
