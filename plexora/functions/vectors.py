"""Expressions and aggregates over ARRAY<DOUBLE> columns; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def scale(a: Column | str, k: Column | float) -> Column:
    return F.transform(col(a), lambda x: x * k)


def relu(a: Column | str) -> Column:
    return F.transform(col(a), lambda x: F.greatest(x.cast("double"), F.lit(0.0)))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def unit(a: Column | str) -> Column:
    n = norm(a)
    return F.transform(col(a), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))


def matvec(matrix: list[list[float]], a: Column | str, bias: list[float] | None = None) -> Column:
    """matrix has a row per output element."""
    rows = [dot(F.array(*map(F.lit, row)), a) for row in matrix]
    return F.array(*[r + F.lit(b) for r, b in zip(rows, bias or [0.0] * len(rows), strict=True)])


def softmax(a: Column | str) -> Column:
    c = col(a)
    e = F.transform(c, lambda x: F.exp(x - F.array_max(c)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def each(how, a: Column | str, dim: int) -> Column:  # noqa: ANN001
    """An aggregate of vectors, element by element, with the usual combine before the shuffle."""
    return F.array(*[how(col(a)[i].cast("double")) for i in range(dim)])


def zeros(dim: int) -> Column:
    return F.array(*[F.lit(0.0)] * dim)
