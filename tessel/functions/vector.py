"""Vector expressions over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in element order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def scaled(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def normalised(a: Column) -> Column:
    """a over its length; the zero vector stays."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def clamped(a: Column, most: float) -> Column:
    """a shortened to length `most` where it is longer."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > most, F.transform(v, lambda x: x * (F.lit(most) / n))).otherwise(v)))


def rounded(a: Column, places: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x, places))


def flattened(rows: Column) -> Column:
    """A matrix (array of rows) as one vector."""
    return F.flatten(rows)


def stacked(v: Column, width: int) -> Column:
    """A vector as rows of `width`; raises where its size is no multiple."""
    whole = F.when(F.size(v) % width != 0, F.raise_error(F.lit("vector does not fit the shape"))).otherwise(v)
    return F.transform(F.sequence(F.lit(0), (F.size(v) / width).cast("int") - 1), lambda i: F.slice(whole, i * width + 1, F.lit(width)))


def mean_by(df, keys: list[str], vector: str, weight: Column | None = None, name: str = "vector"):
    """(Weighted) mean vector by group: one partial sum an element and task, then elements in order."""
    w = F.lit(1.0) if weight is None else weight
    parts = df.select(*keys, w.alias("w"), F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return parts.groupBy(*keys).agg(F.transform(ordered, lambda p: p["x"]).alias(name))
