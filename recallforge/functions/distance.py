"""Distances as column expressions. Up to UNROLLED dimensions the sum is spelled out, which whole-stage
code generation compiles; beyond that a higher-order function is used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

UNROLLED = 128


def l2_squared(a: Column, b: list[float] | Column, dim: int | None = None) -> Column:
    """Squared L2 distance in doubles; null where the lengths differ or a side is null."""
    constant = isinstance(b, list)
    dim = len(b) if constant else dim
    other = F.array(*[F.lit(float(x)) for x in b]) if constant else b
    if dim and dim <= UNROLLED:
        def square(i: int) -> Column:
            d = F.get(a, F.lit(i)).cast("double") - (F.lit(float(b[i])) if constant else F.get(b, F.lit(i)).cast("double"))
            return d * d

        total = reduce(lambda x, y: x + y, [square(i) for i in range(dim)])
        return F.when((F.size(a) == dim) & (F.lit(True) if constant else F.size(b) == dim), total)
    parts = F.zip_with(a, other, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(other), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))
