"""Exact nearest neighbours of a set of queries in one pass over the vectors.

Queries are taken in blocks of BLOCK, each sent to the workers once; every task keeps its own best k a
query (one matrix product a batch), so the shuffle carries k rows per query and task, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.stats import l2
from ..session import prepare
from .topk import best_per

#: Queries in one block: with d dimensions a block takes 8 * BLOCK * d bytes on every worker.
BLOCK = 4096


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column as a matrix; rows must have `dim` numbers."""
    flat = np.asarray(column.flatten(), np.float64)
    if len(flat) != len(column) * dim:
        raise ValueError(f"vectors don't all have {dim} dimensions")
    return flat.reshape(-1, dim)


def _blocks(queries: DataFrame):
    """(ids, matrix) of the queries, block by block, read to the driver one at a time."""
    ids, rows = [], []
    for r in queries.select("query_id", "embedding").toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == BLOCK:
            yield np.array(ids), np.array(rows, float)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, float)


def query_blocks(queries: DataFrame):
    """Rows of the queries in lists of BLOCK at most, read to the driver one list at a time."""
    held: list = []
    for r in queries.toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            yield held
            held = []
    if held:
        yield held


class Best:
    """The k nearest rows of each of n queries that a task has seen."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.sq = k, [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n

    def add(self, i: int, ids: np.ndarray, sq: np.ndarray) -> None:
        if len(sq) > 4 * self.k:  # ties at the border stay
            at = sq <= np.partition(sq, self.k - 1)[self.k - 1]
            ids, sq = ids[at], sq[at]
        ids, sq = np.concatenate([self.ids[i], ids]), np.concatenate([self.sq[i], sq])
        order = np.lexsort((ids, sq))[: self.k]
        self.ids[i], self.sq[i] = ids[order], sq[order]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        """query_id, vec_id, sq of all that is kept."""
        n = [len(x) for x in self.ids]
        columns = np.repeat(query_ids, n), np.concatenate([np.zeros(0, np.int64), *self.ids]), np.concatenate([np.zeros(0), *self.sq])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "sq"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, distance (L2): the k nearest vectors of each query, ties by smaller id."""
    spark, parts = prepare(vectors.sparkSession), []
    shape = "query_id long, vec_id long, sq double"
    for ids, q in _blocks(queries):
        sent = spark.sparkContext.broadcast((ids, q))

        def near(it, sent=sent):
            ids, q = sent.value
            found_ids, found = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for b in it:
                v = matrix(b.column(1), q.shape[1])
                own = np.asarray(b.column(0), np.int64)
                # Rows of equal vectors must tie exactly, which differences give and products don't.
                d = l2(q, v)
                keep = min(k + 8, d.shape[1])
                at = np.argpartition(d, keep - 1, axis=1)[:, :keep] if keep < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(ids), 1))
                cut = np.take_along_axis(d, at, 1).max(axis=1) if keep < d.shape[1] else None
                if cut is not None and (np.sum(d <= (np.sort(np.take_along_axis(d, at, 1), axis=1)[:, k - 1] * (1 + 1e-9) + 1e-9)[:, None], axis=1) > keep).any():
                    at = np.argsort(d, axis=1, kind="stable")  # many ties at the border: take all
                exact = ((q[:, None, :] - v[at]) ** 2).sum(axis=2)
                found_ids, found = np.concatenate([found_ids, own[at]], axis=1), np.concatenate([found, exact], axis=1)
                order = np.lexsort((found_ids, found), axis=1)[:, :k]
                found_ids, found = np.take_along_axis(found_ids, order, 1), np.take_along_axis(found, order, 1)
            n = found.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(found_ids.reshape(-1), pa.int64()), pa.array(found.reshape(-1), pa.float64())], ["query_id", "vec_id", "sq"])

        parts.append(vectors.select(F.col(id_col).cast("long"), "embedding").mapInArrow(near, shape))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double")
    all_rows = parts[0]
    for p in parts[1:]:
        all_rows = all_rows.unionAll(p)
    top = best_per(all_rows, ["query_id"], [F.asc("sq"), F.asc("vec_id")], k)
    return top.select("query_id", "rank", "vec_id", F.sqrt("sq").alias("distance"))


def recall_at(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, recall: share of the true first k (truth is cut to k) among the first k found."""
    t = truth.where(F.col("rank") <= k).select("query_id", "vec_id")
    f = found.where(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return t.join(f, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
