"""Write buffer in front of a grain index: new rows are searched exactly until they are compacted in. The index is
searched as `nprobe` and `exact` say (see GrainIndex.search_mode_a)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.distance import l2_squared
from ..operators.knn import nearest
from ..operators.topk import merge_unique
from .index import GrainIndex


class WriteBuffer:
    def __init__(self, index: GrainIndex, nprobe: int = 1, exact: bool = False):
        self.index, self.nprobe, self.exact = index, nprobe, exact
        self.rows: DataFrame | None = None

    def insert(self, vectors: DataFrame) -> None:
        own = vectors.select("vec_id", "embedding")
        self.rows = own if self.rows is None else self.rows.unionByName(own)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Index and buffer together, each id once, nearest first."""
        found = self.index.search_mode_a(queries, k, self.nprobe, self.exact).drop("rank")
        if self.rows is not None:
            found = found.unionByName(self._held(queries, k))
        return merge_unique(found, ["query_id"], "vec_id", [F.asc("distance"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "distance")

    def _held(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, distance of the nearest buffered rows, summed as the index sums, so that equal vectors tie."""
        near = nearest(self.rows, queries, k).select("query_id", "vec_id").distinct()
        both = near.join(self.rows.withColumnRenamed("embedding", "held"), "vec_id").join(queries.select("query_id", "embedding"), "query_id")
        return both.select("query_id", "vec_id", F.sqrt(l2_squared(F.col("held"), F.col("embedding"), self.index.dim)).alias("distance"))

    def compact(self, n_grains: int | None = None) -> None:
        """Move the buffered rows into the index; they stay visible until that is done."""
        if self.rows is None:
            return
        if n_grains and self.index.raw is not None:
            self.index.build(self.index.raw.unionByName(self.rows), n_grains)
        else:
            self.index.insert(self.rows)
        self.rows = None
