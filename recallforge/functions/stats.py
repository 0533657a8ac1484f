"""Per-dimension statistics of vectors, in plans (one row per dimension) and in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def axis_stats(vectors: DataFrame, *by: str) -> DataFrame:
    """by..., dim, mean, energy (mean square) and variance of each dimension of `embedding`."""
    long = vectors.select(*by, F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return long.groupBy(*by, "dim").agg(F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("energy"), F.var_pop("x").alias("variance"))


def effective_dims(stats: DataFrame, target: float, *by: str) -> DataFrame:
    """by..., dims: how many of the largest variances make up `target` of their sum."""
    from pyspark.sql import Window

    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row per dimension
    along = own.orderBy(F.desc("variance"), "dim")
    upto = stats.withColumn("upto", F.sum("variance").over(along)).withColumn("whole", F.sum("variance").over(own))
    place = upto.withColumn("place", F.row_number().over(along))
    enough = place.where(F.col("upto") >= F.col("whole") * F.lit(target - 1e-12))
    return enough.groupBy(*by).agg(F.min("place").alias("dims"))


def pca(x: np.ndarray, k: int, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(basis of k rows, eigenvalues). Signs are fixed: the largest component of a row is positive."""
    x = np.asarray(x, float)
    y = x - x.mean(axis=0) if centred and len(x) else x
    values, vectors = np.linalg.eigh(y.T @ y / max(1, len(y)))
    order = np.argsort(-values, kind="stable")[:k]
    basis = vectors[:, order].T
    at = np.abs(basis).argmax(axis=1)
    signs = np.where(basis[np.arange(len(basis)), at] < 0, -1.0, 1.0)
    return basis * signs[:, None], np.maximum(values[order], 0.0)


def l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2.0 * a @ b.T + (b * b).sum(1)[None, :], 0.0)
