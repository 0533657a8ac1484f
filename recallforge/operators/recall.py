"""Hybrid recall: filters, candidates, exact scores, shadow filter, merge with the memory tier, top-k."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..schema import HIT_COLUMNS
from ..session import prepare
from .candidates import CandidateGenerator
from .filters import RecallQuery, matching, refused, unshadowed
from .scoring import scored
from .knn import BLOCK
from .topk import best, best_per, merge_order

KEPT = ["segment_id", "local_id", "record_id", "score", "semantic_distance", "symbol_matches", "confidence", "timestamp", "text", "vector_id", "metadata"]


def segment_hits(records: DataFrame, query: RecallQuery, generator: CandidateGenerator | None = None) -> DataFrame:
    """Scored records of the segments that pass the filters and that the generator proposes."""
    rows = matching(records, query)
    if generator is not None:
        proposed = generator.candidates(rows, query).select("segment_id", "local_id")
        if not generator.trusted:
            proposed = refused(proposed, rows)
        rows = rows.join(proposed, ["segment_id", "local_id"], "left_semi")
    if query.fallback_to_recon_on_cold and "cold" in records.columns:
        hot = scored(rows.where(~F.col("cold")), query).select(*KEPT)
        far = scored(rows.where("cold"), RecallQuery(symbols=query.symbols)).select(*KEPT)
        return hot.unionAll(far)
    return scored(rows, query).select(*KEPT)


def recall(records: DataFrame, query: RecallQuery, generator: CandidateGenerator | None = None, memory: DataFrame | None = None, deleted: DataFrame | None = None, strict_compat: bool = False) -> DataFrame:
    """The best `limit` hits with their rank.

    memory: live records of the memory tier, which win over segments; deleted: record_id of deleted
    ones. Ties go to the smaller segment (the memory tier is last), then the smaller record.
    By default shadowed records are dropped before any limit and distances have the same form in both
    tiers. strict_compat drops them after each segment's limit and squares the memory tier's distances.
    """
    hits = segment_hits(records, query, generator)
    shadow = None
    for part in (memory, deleted):
        if part is not None:
            ids = part.select("record_id")
            shadow = ids if shadow is None else shadow.unionAll(ids)
    if strict_compat:
        hits = best_per(hits, ["segment_id"], [F.desc("score"), F.asc("record_id")], query.top, "__rank").drop("__rank")
    if shadow is not None:
        hits = unshadowed(hits, shadow).select(*KEPT)
    if memory is not None:
        last = F.lit((1 << 63) - 1).alias("segment_id")
        own = scored(matching(memory, query), query, squared=strict_compat)
        hits = hits.unionAll(own.select(last, F.lit(0).alias("local_id"), *KEPT[2:]))
    return best(hits, merge_order(), query.top).select(*HIT_COLUMNS)


def _pushed(records: DataFrame, queries: list[RecallQuery]) -> DataFrame:
    """records without rows that no query can want, by comparisons that reach the scan."""
    for value, column, test in (("time_start", "timestamp", lambda c, v: c >= min(v)), ("time_end", "timestamp", lambda c, v: c <= max(v)), ("scope_id", "scope_id", lambda c, v: c.isin(sorted(set(v))) if len(set(v)) <= 1000 else c.between(min(v), max(v)))):
        own = [getattr(q, value) for q in queries]
        if own and None not in own:
            records = records.where(test(F.col(column), own))
    return records


def _has(values: pa.Array, rows: np.ndarray, n: int, wanted) -> np.ndarray:
    """Which of n rows have `wanted` among their values; rows says whose each value is."""
    out = np.zeros(n, bool)
    out[rows[np.asarray(pc.fill_null(pc.equal(values, wanted), False))]] = True
    return out


def recall_many(records: DataFrame, queries: list[tuple[int, RecallQuery]]) -> DataFrame:
    """query_id and hits of many queries in one pass over the records.

    Each task filters and scores its batches for all queries of the list (which the driver holds, and sends in blocks of
    BLOCK) and keeps its own best `limit` a query, so the shuffle carries limit rows per query and task.
    Masks of symbols and metadata are made once a batch; the rest is arithmetic on whole columns.
    """
    shape = "query_id long, segment_id long, record_id long, score double, semantic_distance double, symbol_matches int, confidence float, timestamp long, text string, vector_id string, metadata map<string,string>"
    spark = prepare(records.sparkSession)
    columns = ["segment_id", "record_id", "scope_id", "timestamp", "confidence", "text", "embedding", "symbols", "vector_id", "metadata"]
    kept = ["confidence", "timestamp", "text", "vector_id", "metadata"]
    limits = spark.createDataFrame([(i, q.top) for i, q in queries], "query_id long, __limit int")
    if not queries:
        return spark.createDataFrame([], shape).withColumn("rank", F.lit(1)).select("query_id", *HIT_COLUMNS)
    parts = []
    for start in range(0, len(queries), BLOCK):
        block = queries[start : start + BLOCK]
        sent = spark.sparkContext.broadcast([(i, q, q.normal, None if q.embedding is None else np.array(q.embedding, float)) for i, q in block])

        def run(it, sent=sent):
            for b in it:
                n, at = b.num_rows, {c: b.column(i) for i, c in enumerate(columns)}
                if not n:
                    continue
                scope, time, conf, ids, seg = (np.asarray(at[c]) for c in ("scope_id", "timestamp", "confidence", "record_id", "segment_id"))
                lists = at["symbols"]
                flat, owner = lists.flatten().dictionary_encode(), np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0))
                codes = np.asarray(pc.fill_null(flat.indices, -1), np.int64)
                own = np.unique(owner[codes >= 0] * (len(flat.dictionary) + 1) + codes[codes >= 0])
                distinct = np.bincount(own // (len(flat.dictionary) + 1), minlength=n)
                values = flat.cast(pa.string())
                maps = at["metadata"]
                entries = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(maps.cast(pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))), 0))
                symbol_masks = {w: _has(values, owner, n, w) for w in {w for _, _, normal, _ in sent.value for w in normal}}
                pairs = {kv for _, q, _, _ in sent.value for kv in q.metadata_filter.items()}
                metadata_masks = {(k, v): np.isin(np.arange(n), entries[np.asarray(pc.fill_null(pc.and_(pc.equal(maps.keys, k), pc.equal(maps.items, v)), False))]) for k, v in pairs}
                numbers = np.asarray(at["embedding"].flatten(), float)
                dim = len(numbers) // n
                vectors = numbers.reshape(n, dim) if dim * n == len(numbers) else None
                found = []
                for i, q, normal, e in sent.value:
                    ok = np.ones(n, bool)
                    if q.scope_id is not None:
                        ok &= scope == q.scope_id
                    if q.time_start is not None:
                        ok &= time >= q.time_start
                    if q.time_end is not None:
                        ok &= time <= q.time_end
                    if q.min_confidence is not None:
                        ok &= conf >= np.float32(q.min_confidence)
                    for w in normal:
                        ok &= symbol_masks[w]
                    for kv in q.metadata_filter.items():
                        ok &= metadata_masks[kv]
                    if q.vector_id is not None:
                        ok &= np.asarray(pc.fill_null(pc.equal(at["vector_id"], q.vector_id), False))
                    rows = np.flatnonzero(ok)
                    if not len(rows):
                        continue
                    dist = np.zeros(len(rows))
                    if e is not None:
                        if vectors is None or dim != len(e):
                            raise ValueError("embedding of another dimension than the query's")
                        dist = np.sqrt(((vectors[rows] - e) ** 2).sum(axis=1))
                    score = -dist + 2.0 * len(normal) + 0.01 * distinct[rows] + conf[rows].astype(float)
                    first = np.lexsort((ids[rows], seg[rows], -score))[: q.top]
                    found.append((np.full(len(first), i), rows[first], score[first], dist[first], np.full(len(first), len(normal))))
                if not found:
                    continue
                query_ids, rows, score, dist, matches = (np.concatenate(c) for c in zip(*found))
                taken = pa.array(rows)
                out = [pa.array(query_ids, pa.int64()), at["segment_id"].take(taken), at["record_id"].take(taken), pa.array(score), pa.array(dist), pa.array(matches, pa.int32()), *[at[c].take(taken) for c in kept]]
                yield pa.RecordBatch.from_arrays(out, ["query_id", *columns[:2], "score", "semantic_distance", "symbol_matches", *kept])

        parts.append(_pushed(records, [q for _, q in block]).select(*columns).mapInArrow(run, shape))
    found = reduce(DataFrame.unionAll, parts).join(F.broadcast(limits), "query_id")  # as long as the list that the driver holds
    return best_per(found, ["query_id"], merge_order(), F.col("__limit")).select("query_id", *HIT_COLUMNS)
