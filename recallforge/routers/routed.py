"""Routers at any size: a model fitted to a bounded sample, all rows placed and searched in one pass.

`fit_blocks` makes blocks of a sample of at most TRAIN rows; their means are the model. Every row of the
table belongs to the nearest mean (or the nearest few), a query's route is a list of blocks, and `search`
scans all rows of those blocks exactly. Routes are computed by the workers and read to the driver one
block of queries at a time; rows aren't shuffled, only the best k a query and task are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.stats import l2
from ..operators.knn import Best, matrix, query_blocks
from ..operators.topk import best_per
from ..session import prepare
from .blocks import balanced_blocks

#: Rows that a model is fitted to at most (taken by a hash of their id).
TRAIN = 4096


def sample(vectors: DataFrame, train: int = TRAIN) -> np.ndarray:
    """At most `train` rows as a matrix, in the order of their ids."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(train).collect()
    return np.array([r[1] for r in sorted(rows)], float)


def fit_blocks(vectors: DataFrame, size: int = 16, rounds: int = 2, train: int = TRAIN) -> np.ndarray:
    """Means of balanced blocks of `size` rows of the sample."""
    return balanced_blocks(sample(vectors, train), size, rounds)[1]


def assigned(vectors: DataFrame, means: np.ndarray, posts: int = 1) -> DataFrame:
    """vec_id and block (the nearest of means, ties by number), for each row of vectors; `posts` of them a row."""
    sent = prepare(vectors.sparkSession).sparkContext.broadcast(means)

    def place(it):
        for b in it:
            if b.num_rows:
                own = np.argsort(l2(matrix(b.column(1), sent.value.shape[1]), sent.value), axis=1, kind="stable")[:, :posts]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0), np.int64), own.shape[1]), pa.int64()), pa.array(own.reshape(-1), pa.int32())], ["vec_id", "block"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(place, "vec_id long, block int")


def routes(queries: DataFrame, route: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """query_id, embedding and blocks (the route of each query, best first)."""
    prepare(queries.sparkSession)  # Spark sends a large function, such as one with a model, as a broadcast

    def run(it):
        for b in it:
            found = [np.asarray(route(np.asarray(v.values, np.float64)), np.int64) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], ["query_id", "embedding", "blocks"])

    own = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
    return own.mapInArrow(run, "query_id long, embedding array<double>, blocks array<int>")


def search(vectors: DataFrame, routed: DataFrame, means: np.ndarray, k: int, posts: int = 1) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest rows of each query's blocks, exactly; ties by smaller id."""
    spark, parts = prepare(vectors.sparkSession), []
    for rows in query_blocks(routed):
        ids, q = np.array([r.query_id for r in rows]), np.array([r.embedding for r in rows], float)
        probing = np.zeros((len(means), len(rows)), bool)
        for i, r in enumerate(rows):
            probing[list(r.blocks), i] = True
        sent = spark.sparkContext.broadcast((ids, q, probing, means))

        def near(it, sent=sent):
            ids, q, probing, means = sent.value
            best = Best(len(ids), k)
            for b in it:
                if not b.num_rows:
                    continue
                v, own_ids = matrix(b.column(1), q.shape[1]), np.asarray(b.column(0), np.int64)
                own = np.argsort(l2(v, means), axis=1, kind="stable")[:, :posts]
                seen = probing[own].any(axis=1)  # rows by queries
                for i in np.flatnonzero(seen.any(axis=0)):
                    at = np.flatnonzero(seen[:, i])
                    best.add(i, own_ids[at], ((v[at] - q[i]) ** 2).sum(axis=1))
            yield best.batch(ids)

        parts.append(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(near, "query_id long, vec_id long, sq double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double")
    top = best_per(reduce(DataFrame.unionAll, parts), ["query_id"], [F.asc("sq"), F.asc("vec_id")], k)
    return top.select("query_id", "rank", "vec_id", F.sqrt("sq").alias("distance"))


def chunked(vectors: DataFrame, queries: DataFrame, k: int, chunk: int = 16, slack: float = 2.2) -> DataFrame:
    """query_id, rank, vec_id, distance by partial sums of `chunk` dimensions at a time over all rows: a row whose
    partial sum is over slack times the k-th best of its batch is dropped (approximate)."""
    spark, parts = prepare(vectors.sparkSession), []
    own_queries = queries.select("query_id", "embedding", F.array().cast("array<int>").alias("blocks"))
    for rows in query_blocks(own_queries):
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), np.array([r.embedding for r in rows], float)))

        def near(it, sent=sent):
            ids, q = sent.value
            for b in it:
                if not b.num_rows:
                    continue
                v, own_ids = matrix(b.column(1), q.shape[1]), np.asarray(b.column(0), np.int64)
                keep = min(k, len(v))
                part, alive = np.zeros((len(q), len(v))), np.ones((len(q), len(v)), bool)
                for lo in range(0, q.shape[1], chunk):
                    part += l2(q[:, lo : lo + chunk], v[:, lo : lo + chunk])
                    if lo + chunk < q.shape[1]:
                        cut = np.partition(np.where(alive, part, np.inf), keep - 1, axis=1)[:, keep - 1 : keep]
                        alive &= part <= cut * slack
                part = np.where(alive, part, np.inf)
                at = np.argsort(part, axis=1, kind="stable")[:, : keep + 8]
                exact = np.where(np.take_along_axis(alive, at, 1), ((q[:, None, :] - v[at]) ** 2).sum(axis=2), np.inf)
                i, j = np.nonzero(np.isfinite(exact))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(own_ids[at[i, j]], pa.int64()), pa.array(exact[i, j], pa.float64())], ["query_id", "vec_id", "sq"])

        parts.append(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(near, "query_id long, vec_id long, sq double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double")
    top = best_per(reduce(DataFrame.unionAll, parts), ["query_id"], [F.asc("sq"), F.asc("vec_id")], k)
    return top.select("query_id", "rank", "vec_id", F.sqrt("sq").alias("distance"))
