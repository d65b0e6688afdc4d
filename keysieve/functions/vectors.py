"""Column functions on dense vectors stored as array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null, so never similar, when either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def mean_pool(vectors: Column) -> Column:
    """Mean of the token vectors of one text (array<array<double>>); null for a text without tokens."""
    first = F.get(vectors, F.lit(0))
    summed = F.aggregate(vectors, F.transform(first, lambda _: F.lit(0.0)),
                         lambda total, v: F.zip_with(total, v, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / F.size(vectors))


def to_json(embedding: Column) -> Column:
    return F.to_json(embedding)


def from_json(embedding: Column) -> Column:
    return F.from_json(embedding, "array<double>")
