"""Vector scores as column expressions inside the JVM: sums in double and in index order, by higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

COSINE, DOT, EUCLID, MANHATTAN = "Cosine", "Dot", "Euclid", "Manhattan"


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: x * y))


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    norms = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: F.abs(x - y)))


def score(distance: str, a: Column, b: Column) -> Column:
    """More is nearer: dot, cosine, minus Euclidean distance, minus city-block distance; null for unlike lengths."""
    kinds = {DOT: dot, COSINE: cosine, EUCLID: lambda x, y: 0.0 - F.sqrt(squared_distance(x, y)), MANHATTAN: lambda x, y: 0.0 - manhattan(x, y)}
    return F.when(F.size(a) == F.size(b), kinds[distance](a, b))


def raw_similarity(distance: str, a: Column, b: Column) -> Column:
    """What example-based scoring compares: as ``score``, but Euclid without the root."""
    return 0.0 - squared_distance(a, b) if distance == EUCLID else score(distance, a, b)


def normalised(a: Column) -> Column:
    """Unit length; left as it is if it has almost no length, or already length 1 within 1e-6."""
    squares = squared_norm(a)
    scaled = F.transform(a, lambda x: x.cast("double") / F.sqrt(squares))
    return F.when((squares < 1.1920929e-7) | (F.abs(squares - 1) <= 1e-6), F.transform(a, lambda x: x.cast("double"))).otherwise(scaled)


def sigmoid(x: Column) -> Column:
    """x / (1 + |x|) moved to 0..1."""
    return (x / (F.abs(x) + 1) + 1) * 0.5


def mean_vector(column: Column, dim: int) -> list[Column]:
    """Aggregates for the mean of a vector column, component by component."""
    return [F.avg(column[i].cast("double")) for i in range(dim)]
