"""Vector arithmetic as column expressions (double accumulation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances are compared at this many decimals, so equal vectors tie and ids decide.
DISTANCE_DECIMALS = 9


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of equal length."""
    def gap(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _sum(F.zip_with(a, b, gap))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalize(v: Column, norm: Column | None = None) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = l2_norm(v) if norm is None else norm
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def has_dimension(v: Column, dim: int) -> Column:
    """True for a vector of the given length without null parts."""
    return F.coalesce(
        (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()), F.lit(False)
    )
