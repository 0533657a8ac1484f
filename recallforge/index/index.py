"""The grain index over DataFrames: centroids and grain parameters are a small model on the driver, the
codes of all vectors are a distributed table partitioned by grain.

Searching a set of queries ranks grains per query, joins the probed grains' codes, scores them in Arrow
batches with the grain's integer weights, keeps the best per query and grain, removes repeated ids and
reranks against raw vectors where there are any, else against reconstructions.

How many candidates of a grain hold the true nearest depends on its size, so no fixed number is enough. An `exact`
search takes the last distance found for each query as its bound and reads the raw vectors once more for rows within it.
"""

from __future__ import annotations

import uuid
import warnings
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.stats import l2
from ..operators.knn import Best, matrix, query_blocks
from ..operators.topk import best_per, merge_unique
from ..session import prepare
from ..sources.files import Files
from ..streaming.streams import shared_dir
from . import grain as grains, kmeans, shared_pq, store

CODES = "grain_id int, ordinal int, vec_id long, coords array<smallint>, residual int, sketch array<tinyint>, pq array<smallint>"
FOUND = "query_id long, grain_id int, vec_id long, approx double, recon double"


@dataclass
class Options:
    local_dim: int = 16
    sketch_dim: int = 8
    block_size: int = 64
    rerank_factor: int = 4
    residual_bits: int = 8
    adaptive: float | None = None
    shared_parts: int | None = None
    shared_bits: int = 8
    shared_rotate: bool = False
    split_at: int | None = None
    train_rows: int = 100_000


@dataclass
class GrainIndex:
    spark: SparkSession
    dim: int
    options: Options = field(default_factory=Options)
    centroids: np.ndarray | None = None
    models: dict = field(default_factory=dict)
    shared: object = None
    codes: DataFrame | None = None
    raw: DataFrame | None = None
    router: object = None
    parts: tuple[str, ...] = ()

    def __post_init__(self):
        if not 0 < self.options.local_dim <= self.dim:
            raise ValueError("local_dim is between 1 and dim")
        prepare(self.spark)

    # -- building --------------------------------------------------------------------------------

    def _sample(self, vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Rows to train on: all, or `train_rows` of them chosen by a hash of their id."""
        rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(self.options.train_rows).collect()
        rows.sort(key=lambda r: r[0])
        return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)

    def build(self, vectors: DataFrame, n_grains: int) -> "GrainIndex":
        """Train on a bounded sample (see Options.train_rows), then encode every row."""
        _, x = self._sample(vectors)
        if x.ndim != 2 or x.shape[1] != self.dim:
            raise ValueError(f"vectors must have {self.dim} dimensions")
        own = np.zeros(len(x), int) if n_grains <= 1 else kmeans.two_means(x) if n_grains == 2 else kmeans.balanced(x, n_grains)
        names = np.unique(own)
        own = np.searchsorted(names, own)
        self.centroids = np.array([x[own == g].mean(axis=0) for g in range(len(names))])
        self._train(x, own)
        self._store(vectors)
        self.raw = vectors.select("vec_id", "embedding")
        return self

    def _train(self, x: np.ndarray, own: np.ndarray) -> None:
        o = self.options
        if o.shared_parts:
            self.shared, self.models = shared_pq.train(x, own, o.local_dim, o.shared_parts, o.shared_bits, o.shared_rotate)
            return
        self.shared, self.models = None, {}
        for g in range(len(self.centroids)):
            shape = o.local_dim, o.sketch_dim, o.residual_bits
            if o.adaptive:
                shape = grains.adaptive_shape(x[own == g], o.adaptive, (1, o.local_dim), (0, o.sketch_dim), o.residual_bits, 8)
            self.models[g] = grains.train(x[own == g], *shape)

    def _store(self, vectors: DataFrame, parts: tuple[str, ...] = ()) -> None:
        """Encode vectors once, into files by grain in the shared folder, beside those of `parts`; a search reads the
        folders of the grains it probes. Files are never changed, so a copy of this object keeps what it has."""
        root = parts[0].rsplit("/", 1)[0] if parts else f"{shared_dir(self.spark)}/index-{uuid.uuid4().hex}"
        path = f"{root}/batch={uuid.uuid4().hex}"
        self._encode(vectors).write.partitionBy("grain_id").parquet(path)
        self.parts = (*parts, path)
        shape = self.spark.createDataFrame([], CODES).schema.add("batch", "string")
        self.codes = self.spark.read.schema(shape).option("basePath", root).parquet(*self.parts).drop("batch")

    def clone(self) -> "GrainIndex":
        """An index of its own over the same files; changes of one aren't seen by the other."""
        return replace(self, centroids=None if self.centroids is None else self.centroids.copy(), models=dict(self.models))

    def _encode(self, vectors: DataFrame) -> DataFrame:
        sent = self.spark.sparkContext.broadcast((self.centroids, self.models, self.shared))

        def run(it):
            centroids, models, shared = sent.value
            for pdf in it:
                if not len(pdf):
                    continue
                x = np.array(pdf["embedding"].tolist(), float)
                near = l2(x, centroids).argmin(axis=1)
                for g in np.unique(near):
                    at = near == g
                    if shared is not None:
                        coords = models[g].coords(shared, x[at])
                        left = x[at] - models[g].base(shared, coords)
                        pq, residual, sketch = shared.codes(left), np.zeros(at.sum(), int), np.zeros((at.sum(), 0), int)
                    else:
                        (coords, residual, sketch), pq = models[g].encode(x[at]), np.zeros((at.sum(), 0), int)
                    yield pd.DataFrame({"grain_id": np.full(at.sum(), g, np.int32), "ordinal": np.zeros(at.sum(), np.int32), "vec_id": pdf["vec_id"].to_numpy()[at], "coords": list(coords.astype(np.int16)), "residual": residual.astype(np.int32), "sketch": list(sketch.astype(np.int8)), "pq": list(pq.astype(np.int16))})

        return vectors.select("vec_id", "embedding").mapInPandas(run, CODES)

    def insert(self, vectors: DataFrame) -> "GrainIndex":
        """Encode rows with the grains' present parameters and append them; ids aren't replaced."""
        if self.centroids is None:
            return self.build(vectors, 1)
        self._store(vectors, self.parts) if self.parts else self._append(vectors)
        self.raw = None if self.raw is None else self.raw.unionByName(vectors.select("vec_id", "embedding"))
        return self

    def _append(self, vectors: DataFrame) -> None:
        """The same for an index whose codes were loaded from elsewhere."""
        loaded = self.codes
        self._store(vectors)
        self.codes = loaded.unionByName(self.codes)
        self.parts = ()

    def attach_raw_vectors(self, vectors: DataFrame) -> None:
        self.raw = vectors.select("vec_id", "embedding")

    def split_large(self) -> int:
        """Split grains of at least split_at rows in two where both sides keep a block; returns how many.

        Grain sizes come from one aggregation; only a large grain's bounded sample reaches the driver.
        """
        o, done = self.options, 0
        if not o.split_at:
            return 0
        for r in self.codes.groupBy("grain_id").count().where(F.col("count") >= max(o.split_at, 2 * o.block_size)).orderBy("grain_id").collect():
            rows = self.codes.where(F.col("grain_id") == r.grain_id).select("vec_id").join(self.raw, "vec_id")
            _, x = self._sample(rows)
            own = kmeans.two_means(x)
            if min((own == 0).sum(), (own == 1).sum()) < o.block_size:
                continue
            self.centroids[r.grain_id] = x[own == 0].mean(axis=0)
            self.centroids = np.vstack([self.centroids, x[own == 1].mean(axis=0)])
            done += 1
        if done:
            _, x = self._sample(self.raw)
            own = l2(x, self.centroids).argmin(axis=1)
            full = np.unique(own)
            self.centroids = self.centroids[full]
            self._train(x, np.searchsorted(full, own))
            self._store(self.raw)
            if self.router is not None:
                self.router = store.router_from(store.router_parts(self.router), self.centroids)
        return done

    # -- searching -------------------------------------------------------------------------------

    def _probes(self, queries: list[tuple[int, np.ndarray]], nprobe: int | None) -> dict[int, list[tuple[int, np.ndarray]]]:
        """Queries of each probed grain."""
        from ..routers.lattice import refined

        n, out = len(self.centroids), {}
        k = n if nprobe is None else max(1, min(nprobe, n))
        for i, q in queries:
            order = refined(self.router, self.centroids, q, k) if self.router is not None else np.lexsort((np.arange(n), ((self.centroids - q) ** 2).sum(axis=1)))
            for g in order[:k]:
                out.setdefault(int(g), []).append((i, q))
        return out

    def _scan(self, queries: DataFrame, nprobe: int | None, keep: int) -> DataFrame:
        """query_id, grain_id, vec_id, approx, recon (squared distance to the reconstruction): the best `keep` of
        each query, grain and task. Queries go out in blocks; all queries of a grain are scored by matrix products."""
        found = [self._scan_block([(r.query_id, np.array(r.embedding, float)) for r in rows], nprobe, keep) for rows in query_blocks(queries.select("query_id", "embedding"))]
        if not found:
            return self.spark.createDataFrame([], FOUND)
        return reduce(DataFrame.unionAll, found)

    def _scan_block(self, queries: list[tuple[int, np.ndarray]], nprobe: int | None, keep: int) -> DataFrame:
        probes = {g: (np.array([i for i, _ in own]), np.array([q for _, q in own])) for g, own in self._probes(queries, nprobe).items()}
        sent = self.spark.sparkContext.broadcast((probes, self.models, self.shared))
        codes = self.codes.where(F.col("grain_id").isin(sorted(probes))) if len(probes) < len(self.centroids) else self.codes
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]

        def run(it):
            probes, models, shared = sent.value
            for b in it:
                grains_of = np.asarray(b.column(0), np.int64)
                for g in np.unique(grains_of):
                    part = b.filter(pa.array(grains_of == g))
                    flat = lambda i: np.asarray(part.column(i).flatten(), np.int64).reshape(part.num_rows, -1)  # noqa: B023, E731
                    m, (query_ids, q) = models[int(g)], probes[int(g)]
                    ids, coords = np.asarray(part.column(1), np.int64), flat(2)
                    if shared is None:
                        residual, sketch = np.asarray(part.column(3), np.int64), flat(4)
                        back, over = m.decode(coords, sketch), m.left_over(residual, sketch)
                        recon = l2(q, back) + over
                        approx = m.scores(q, coords, residual, sketch)
                    else:
                        approx = recon = l2(q, shared_pq.reconstruct(shared, m, coords, flat(5)))
                    if keep < len(ids):
                        cut = np.partition(approx, keep - 1, axis=1)[:, keep - 1 : keep]
                        i, j = np.nonzero(approx <= cut)  # ties at the border stay
                    else:
                        i, j = np.nonzero(np.ones(approx.shape, bool))
                    columns = query_ids[i], np.full(len(i), g), ids[j], approx[i, j], recon[i, j]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["query_id", "grain_id", "vec_id", "approx", "recon"])

        return codes.select("grain_id", "vec_id", "coords", "residual", "sketch", "pq").mapInArrow(run, FOUND)

    def _rerank(self, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        if self.raw is not None:
            from ..functions.distance import l2_squared

            near = found.join(self.raw.select("vec_id", F.col("embedding").alias("__x")), "vec_id", "left").join(queries.select("query_id", "embedding"), "query_id")
            found = near.withColumn("sq", F.coalesce(l2_squared(F.col("__x"), F.col("embedding"), self.dim), F.col("recon")))
        else:
            found = found.withColumn("sq", F.col("recon"))
        # An id may be in several grains and several times in the raw rows: its nearest row counts.
        return merge_unique(found, ["query_id"], "vec_id", [F.asc("sq"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", F.sqrt("sq").alias("distance"))

    def _within(self, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id: of each query and task the k nearest raw rows within the last distance found, or of all
        raw rows where fewer than k are found."""
        last = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("last"))
        parts = []
        for rows in query_blocks(queries.select("query_id", "embedding").join(last, "query_id", "left")):
            cut = np.array([np.inf if r.last is None else r.last**2 * (1 + 1e-9) for r in rows])
            sent = self.spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), np.array([r.embedding for r in rows], float), cut))

            def near(it, sent=sent):
                ids, q, cut = sent.value
                best = Best(len(ids), k)
                for whole in it:
                    for at in range(0, whole.num_rows, 1000):
                        b = whole.slice(at, 1000)
                        own, v = np.asarray(b.column(0), np.int64), matrix(b.column(1), q.shape[1])
                        # A little more, since products and sums in another order differ in the last digits.
                        i, j = np.nonzero(l2(q, v) <= cut[:, None] + 1e-12 * ((q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :]))
                        starts = np.flatnonzero(np.diff(i, prepend=-1))
                        for n, rows_of in zip(i[starts], np.split(j, starts[1:])):
                            best.add(n, own[rows_of], ((v[rows_of] - q[n]) ** 2).sum(axis=1))
                yield best.batch(ids).select(["query_id", "vec_id"])

            parts.append(self.raw.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(near, "query_id long, vec_id long"))
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], "query_id long, vec_id long")

    def _complete(self, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """found (the result of a search) with the rows that it lacks of the true k nearest."""
        if self.raw is None:
            raise ValueError("an exact search needs the raw vectors")
        path = f"{shared_dir(self.spark)}/found-{uuid.uuid4().hex}"
        found.write.parquet(path)  # k rows a query, read for the bounds and for the result
        found = self.spark.read.schema(found.schema).parquet(path).select("query_id", "vec_id", "distance")
        pairs = found.select("query_id", "vec_id").unionAll(self._within(found, queries, k)).distinct()
        return self._rerank(pairs.withColumn("recon", F.lit(None).cast("double")), queries, k)

    def search_mode_a(self, queries: DataFrame, k: int, nprobe: int | None = None, exact: bool = False) -> DataFrame:
        """Best k * rerank_factor of every probed grain, merged and reranked; with rerank_factor 0 the
        quantized distances decide. With `exact`, rows nearer than the last found are added from all raw vectors."""
        if exact:
            return self._complete(self.search_mode_a(queries, k, nprobe), queries, k)
        rf = self.options.rerank_factor
        keep = k * max(rf, 1)
        found = best_per(self._scan(queries, nprobe, keep), ["query_id", "grain_id"], [F.asc("approx"), F.asc("vec_id")], keep).drop("rank")
        if rf == 0:
            return best_per(found, ["query_id"], [F.asc("approx"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", F.sqrt(F.greatest("approx", F.lit(0.0))).alias("distance"))
        return self._rerank(found, queries, k)

    def candidates(self, queries: DataFrame, candidate_k: int, nprobe: int | None = None) -> DataFrame:
        """The best candidate_k of the probed grains together: query_id, rank, vec_id, approx, recon, grain_id."""
        found = self._scan(queries, nprobe, candidate_k)
        once = best_per(found, ["query_id", "vec_id"], [F.asc("approx"), F.asc("grain_id")], 1).drop("rank")
        return best_per(once, ["query_id"], [F.asc("approx"), F.asc("vec_id")], candidate_k)

    def search_mode_b(self, queries: DataFrame, k: int, candidate_k: int, nprobe: int | None = None) -> DataFrame:
        return self._rerank(self.candidates(queries, candidate_k, nprobe).drop("rank"), queries, k)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """All grains, as mode A. Deprecated name."""
        warnings.warn("search is deprecated; use search_mode_a", DeprecationWarning, stacklevel=2)
        return self.search_mode_a(queries, k)

    search_many = search

    def search_tiered(self, queries: DataFrame, k: int, candidate_k: int, nprobe: int | None = None) -> DataFrame:
        """Mode B. Deprecated name."""
        warnings.warn("search_tiered is deprecated; use search_mode_b", DeprecationWarning, stacklevel=2)
        return self.search_mode_b(queries, k, candidate_k, nprobe)

    search_many_tiered = search_tiered

    def scan_below(self, queries: DataFrame, threshold: float, nprobe: int | None = None) -> DataFrame:
        """All rows whose quantized squared distance is below a threshold."""
        return self._scan(queries, nprobe, 1 << 40).where(F.col("approx") < threshold)

    # -- keeping ---------------------------------------------------------------------------------

    def stats(self) -> DataFrame:
        """grain_id, rows, coords, sketch, pq: sizes and shapes of the grains."""
        return self.codes.groupBy("grain_id").agg(F.count("*").alias("rows"), F.max(F.size("coords")).alias("coords"), F.max(F.size("sketch")).alias("sketch"), F.max(F.size("pq")).alias("pq"))

    def encoded_bytes(self) -> int:
        """Bytes of codes: 2 a coordinate and residual, residual_bits a sketch value, shared_bits a PQ code."""
        o, coord = self.options, 1 if self.shared is not None else 2
        row = F.size("coords") * coord + (0 if self.shared is not None else 2) + F.ceil(F.size("sketch") * o.residual_bits / 8) + F.ceil(F.size("pq") * o.shared_bits / 8)
        return int(self.codes.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0])

    def save(self, path: str) -> None:
        self.codes.write.partitionBy("grain_id").parquet(f"{path}/codes")
        Files(self.spark).publish(f"{path}/model.json", store.dump(dim=self.dim, options=asdict(self.options), centroids=self.centroids, models=self.models, shared=self.shared, router=store.router_parts(self.router)))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "GrainIndex":
        """A saved index, without raw vectors."""
        m = store.load(Files(spark).read(f"{path}/model.json"))
        out = GrainIndex(spark, m["dim"], Options(**m["options"]), m["centroids"], m["models"], m["shared"], None, None, store.router_from(m["router"], m["centroids"]))
        out.codes = spark.read.schema(CODES).parquet(f"{path}/codes")
        return out
