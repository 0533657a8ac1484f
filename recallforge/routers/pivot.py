"""Pivot-prefix postings and dense pivot sketches.

The build is sequential and small. Routing of many queries is a relational plan: the query's nearest
pivots join the postings, weights are summed per block, the best blocks' rows are scanned exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.distance import l2_squared
from ..functions.stats import l2
from ..operators.knn import Best, matrix, query_blocks
from ..operators.topk import best_per
from ..session import prepare
from .blocks import balanced_blocks, farthest_first, guard

POOL_FLOOR = 16


@dataclass(frozen=True)
class PivotConfig:
    block_size: int = 64
    pivot_count: int = 64
    prefix_len: int = 2
    top_blocks: int = 4
    candidate_pool: int = 256
    mode: str = "weighted"
    rounds: int = 2


def segment_config(n: int) -> PivotConfig:
    """The settings that suit a segment of n rows."""
    return PivotConfig(min(max(n, 1), 64), min(max(n // 8, 16), 256), 2, min(max(n // 128, 1), 4), n, "weighted", 2)


class PivotPrefix:
    def __init__(self, x: np.ndarray, config: PivotConfig = PivotConfig()):
        if min(config.block_size, config.pivot_count, config.prefix_len) < 1:
            raise ValueError("block size, pivots and prefix are at least 1")
        self.x, self.config = guard(x), config
        self.blocks, self.means = balanced_blocks(self.x, config.block_size, config.rounds)
        self.pivots = self.means[farthest_first(self.means, min(config.pivot_count, len(self.means)))]
        self.prefix_len = min(config.prefix_len, len(self.pivots))
        near = np.sqrt(l2(self.means, self.pivots))
        self.prefix = np.argsort(near, axis=1, kind="stable")[:, : self.prefix_len]
        df = np.bincount(self.prefix.reshape(-1), minlength=len(self.pivots))
        self.idf = np.log((len(self.means) + 1.0) / (df + 1.0)) + 1.0

    def postings(self) -> list[tuple[int, int, int, float]]:
        """(pivot, block, place of the pivot in the block's prefix, idf)."""
        return [(int(p), b, i, float(self.idf[p])) for b, row in enumerate(self.prefix) for i, p in enumerate(row)]

    def weight(self, pivot: int, qpos: int, bpos: int) -> float:
        return self.idf[pivot] / ((qpos + 1) * (bpos + 1)) if self.config.mode == "weighted" else 1.0 / (qpos + bpos + 1)

    def select(self, scores: dict[int, float]) -> list[int]:
        if not scores:
            return list(range(min(self.config.top_blocks, len(self.blocks))))
        return sorted(scores, key=lambda b: (-scores[b], b))[: self.config.top_blocks]

    def scan(self, q: np.ndarray, blocks: list[int]) -> np.ndarray:
        rows = np.concatenate([self.blocks[b] for b in blocks]) if blocks else np.zeros(0, int)
        d = ((self.x[rows] - q) ** 2).sum(axis=1)
        return rows[np.lexsort((rows, d))][: self.config.candidate_pool]

    def route(self, q: np.ndarray) -> tuple[np.ndarray, bool, dict]:
        """(rows, nearest first; whether to fall back; counters)."""
        q = np.asarray(q, float)
        near = np.argsort(np.sqrt(((self.pivots - q) ** 2).sum(axis=1)), kind="stable")[: self.prefix_len]
        scores: dict[int, float] = {}
        entries = 0
        for qpos, p in enumerate(near):
            for block, bpos in zip(*np.nonzero(self.prefix == p)):
                entries += 1
                scores[int(block)] = scores.get(int(block), 0.0) + self.weight(int(p), qpos, int(bpos))
        chosen = self.select(scores)
        found = self.scan(q, chosen)
        trace = {
            "pivot_evals": len(self.pivots), "posting_entries": entries, "unique_blocks": len(scores), "duplicate_blocks": entries - len(scores),
            "selected_blocks": len(chosen), "centroid_evals": int(sum(len(self.blocks[b]) for b in chosen)), "candidates": len(found),
            "working_set_bytes": 4 * self.pivots.size + 5 * entries + 12 * len(scores) + 4 * self.x.shape[1] * int(sum(len(self.blocks[b]) for b in chosen)),
        }
        return found, len(found) < min(POOL_FLOOR, len(self.x)), trace

    def resident_bytes(self) -> int:
        return 4 * (self.x.size + self.means.size + self.pivots.size + len(self.x) + len(self.idf)) + 7 * self.prefix.size + 4 * (len(self.blocks) + len(self.pivots) + 2)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pivots: pivot, embedding; postings: pivot, block, bpos, idf; payload: block, vec_id, embedding)."""
        pivots = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(self.pivots)], "pivot int, embedding array<double>")
        posts = spark.createDataFrame(self.postings(), "pivot int, block int, bpos int, idf double")
        rows = [(b, int(r), [float(v) for v in self.x[r]]) for b, rows in enumerate(self.blocks) for r in rows]
        return pivots, posts, spark.createDataFrame(rows, "block int, vec_id long, embedding array<double>")


def build_for_segment(x: np.ndarray) -> PivotPrefix:
    return PivotPrefix(x, segment_config(len(x)))


def route_blocks(queries: DataFrame, pivots: DataFrame, postings: DataFrame, prefix_len: int, top_blocks: int, mode: str = "weighted", dim: int | None = None) -> DataFrame:
    """query_id, rank, block, score of the best blocks. pivots is a small model table (broadcast)."""
    p = F.broadcast(pivots.select("pivot", F.col("embedding").alias("__p")))
    d = queries.select("query_id", "embedding").join(p).select("query_id", "pivot", l2_squared(F.col("embedding"), F.col("__p"), dim).alias("sq"))
    near = best_per(d, ["query_id"], [F.asc("sq"), F.asc("pivot")], prefix_len, "qpos")
    weight: Column = F.col("idf") / (F.col("qpos") * (F.col("bpos") + 1)) if mode == "weighted" else 1.0 / (F.col("qpos") + F.col("bpos"))
    scores = near.join(postings, "pivot").groupBy("query_id", "block").agg(F.sum(weight).alias("score"))
    return best_per(scores, ["query_id"], [F.desc(F.round("score", 9)), F.asc("block")], top_blocks).select("query_id", "rank", "block", "score")


def scan_blocks(queries: DataFrame, chosen: DataFrame, payload: DataFrame, pool: int, dim: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance: the nearest rows of the chosen blocks. Queries go out in blocks of BLOCK with their
    lists; the payload (block, vec_id, embedding) is read once for each and isn't shuffled."""
    spark, parts = prepare(payload.sparkSession), []
    lists = chosen.groupBy("query_id").agg(F.sort_array(F.collect_list(F.col("block").cast("long"))).alias("blocks"))
    held = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).join(lists, "query_id")
    for rows in query_blocks(held):
        probing: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            for block in r.blocks:
                probing.setdefault(block, []).append(i)
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), np.array([r.embedding for r in rows], float), {b: np.array(i) for b, i in probing.items()}))

        def near(it, sent=sent):
            ids, q, probing = sent.value
            best = Best(len(ids), pool)
            for b in it:
                if b.num_rows:
                    v, own, block = matrix(b.column(2), q.shape[1]), np.asarray(b.column(1), np.int64), np.asarray(b.column(0), np.int64)
                    for g in np.unique(block):
                        for i in probing.get(int(g), ()):
                            at = block == g
                            best.add(i, own[at], ((v[at] - q[i]) ** 2).sum(axis=1))
            yield best.batch(ids)

        parts.append(payload.select(F.col("block").cast("long"), F.col("vec_id").cast("long"), "embedding").mapInArrow(near, "query_id long, vec_id long, sq double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double")
    found = reduce(DataFrame.unionAll, parts)
    return best_per(found, ["query_id"], [F.asc("sq"), F.asc("vec_id")], pool).select("query_id", "rank", "vec_id", F.sqrt("sq").alias("distance"))


class DenseSketch:
    """Every block's distances to all pivots; blocks in the order of the largest difference from the query's."""

    def __init__(self, x: np.ndarray, config: PivotConfig = PivotConfig(), metric: str = "linf"):
        self.x, self.config, self.metric = guard(x), config, metric
        self.blocks, self.means = balanced_blocks(self.x, config.block_size, config.rounds)
        self.pivots = self.means[farthest_first(self.means, min(config.pivot_count, len(self.means)))]
        self.sketch = np.sqrt(l2(self.means, self.pivots))

    def stored(self, kind: str) -> np.ndarray:
        """The sketch after storing it as fp16 or as u16 with one minimum and scale."""
        if kind == "fp16":
            return self.sketch.astype(np.float16).astype(float)
        low, high = self.sketch.min(), self.sketch.max()
        scale = (high - low) / 65535.0 if high > low else 1.0
        return np.rint((self.sketch - low) / scale) * scale + low

    def route(self, q: np.ndarray, sketch: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
        diff = np.abs((self.sketch if sketch is None else sketch) - np.sqrt(((self.pivots - q) ** 2).sum(axis=1)))
        score = {"linf": diff.max(axis=1), "l1": diff.sum(axis=1), "l2": (diff**2).sum(axis=1)}[self.metric]
        chosen = np.argsort(score, kind="stable")[: self.config.top_blocks]
        rows = np.concatenate([self.blocks[b] for b in chosen])
        found = rows[np.lexsort((rows, ((self.x[rows] - q) ** 2).sum(axis=1)))][: self.config.candidate_pool]
        return found, len(found) < min(POOL_FLOOR, len(self.x))

    def resident_bytes(self) -> int:
        return 4 * (self.x.size + self.means.size + self.pivots.size + self.sketch.size + len(self.x))


def dense_route(queries: DataFrame, sketch: DenseSketch) -> DataFrame:
    """query_id, rank, block, score of the top_blocks blocks of each query; the sketch is a small model."""
    sent = prepare(queries.sparkSession).sparkContext.broadcast(sketch)

    def run(it):
        for b in it:
            own, found = sent.value, []
            for i, q in zip(b.column(0).to_pylist(), matrix(b.column(1), sent.value.pivots.shape[1]) if b.num_rows else ()):
                score = np.abs(own.sketch - np.sqrt(((own.pivots - q) ** 2).sum(axis=1))).max(axis=1)
                order = np.lexsort((np.arange(len(score)), np.round(score, 9)))[: own.config.top_blocks]
                found += [(i, rank, int(c), float(score[c])) for rank, c in enumerate(order, 1)]
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["query_id", "rank", "block", "score"])

    return queries.select(F.col("query_id").cast("long"), "embedding").mapInArrow(run, "query_id long, rank int, block int, score double")
