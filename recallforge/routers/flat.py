"""Nearest centroid and full centroid order, as plans over a checked, small centroid table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.distance import l2_squared
from ..operators.topk import best_per

#: Centroids that may be joined by broadcast; a larger table goes through knn.nearest.
MOST = 65_536


def _pairs(queries: DataFrame, centroids: DataFrame, dim: int | None) -> DataFrame:
    n = centroids.count()
    if n > MOST:
        raise ValueError(f"{n} centroids; use knn.nearest beyond {MOST}")
    c = F.broadcast(centroids.select("grain_id", F.col("centroid")))
    return queries.select("query_id", "embedding").join(c).select("query_id", "grain_id", l2_squared(F.col("embedding"), F.col("centroid"), dim).alias("sq"))


def assign(queries: DataFrame, centroids: DataFrame, dim: int | None = None) -> DataFrame:
    """query_id and the grain of its nearest centroid, ties by smaller grain."""
    return best_per(_pairs(queries, centroids, dim), ["query_id"], [F.asc("sq"), F.asc("grain_id")], 1).select("query_id", "grain_id", "sq")


def order(queries: DataFrame, centroids: DataFrame, nprobe: int, dim: int | None = None) -> DataFrame:
    """query_id, rank, grain_id: the nprobe nearest grains of each query."""
    return best_per(_pairs(queries, centroids, dim), ["query_id"], [F.asc("sq"), F.asc("grain_id")], nprobe).select("query_id", "rank", "grain_id", "sq")


def class_centroids(vectors: DataFrame, by: str) -> DataFrame:
    """grain_id and centroid (mean per dimension) of each value of a column."""
    long = vectors.select(F.col(by).cast("long").alias("grain_id"), F.posexplode("embedding").alias("pos", "x"))
    mean = long.groupBy("grain_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("grain_id").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("p")).select("grain_id", F.transform("p", lambda p: p["m"]).alias("centroid"))
