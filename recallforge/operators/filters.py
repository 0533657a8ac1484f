"""Recall queries and their predicates, segment statistics and pruning, shadow filter, checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import normal_symbol_py


@dataclass
class RecallQuery:
    """A conjunction of filters, an optional embedding to rank by, and a limit (at least 1)."""

    embedding: list[float] | None = None
    symbols: list[str] = field(default_factory=list)
    scope_id: int | None = None
    time_start: int | None = None
    time_end: int | None = None
    min_confidence: float | None = None
    limit: int = 10
    candidate_budget: int | None = None
    vector_id: str | None = None
    metadata_filter: dict[str, str] = field(default_factory=dict)
    fallback_to_recon_on_cold: bool = False

    @property
    def top(self) -> int:
        return max(self.limit, 1)

    @property
    def normal(self) -> list[str]:
        """Normal symbols, repeats kept."""
        return [normal_symbol_py(s) for s in self.symbols]


def column_predicate(q: RecallQuery) -> Column:
    """Scope, inclusive time bounds, confidence (compared as float), vector id and metadata."""
    parts = [F.lit(True)]
    if q.scope_id is not None:
        parts.append(F.col("scope_id") == F.lit(q.scope_id))
    if q.time_start is not None:
        parts.append(F.col("timestamp") >= F.lit(q.time_start))
    if q.time_end is not None:
        parts.append(F.col("timestamp") <= F.lit(q.time_end))
    if q.min_confidence is not None:
        parts.append(F.col("confidence") >= F.lit(float(q.min_confidence)).cast("float"))
    if q.vector_id is not None:
        parts.append(F.col("vector_id") == F.lit(q.vector_id))
    parts += [F.col("metadata")[F.lit(k)] == F.lit(v) for k, v in q.metadata_filter.items()]
    return reduce(lambda a, b: a & b, parts)


def symbol_predicate(q: RecallQuery) -> Column:
    """All of the query's symbols are among the record's."""
    return reduce(lambda a, b: a & b, [F.array_contains("symbols", F.lit(s)) for s in dict.fromkeys(q.normal)], F.lit(True))


def matching(records: DataFrame, q: RecallQuery) -> DataFrame:
    """Records that pass every filter. Plain comparisons reach the Parquet scan."""
    return records.where(column_predicate(q)).where(symbol_predicate(q))


def segment_stats(records: DataFrame) -> DataFrame:
    """segment_id, n, scope_min, scope_max, time_min, time_max, dim: one row per segment."""
    return records.groupBy("segment_id").agg(
        F.count("*").alias("n"), F.min("scope_id").alias("scope_min"), F.max("scope_id").alias("scope_max"),
        F.min("timestamp").alias("time_min"), F.max("timestamp").alias("time_max"), F.max(F.size("embedding")).alias("dim"),
    )


def prune(stats: DataFrame, q: RecallQuery) -> DataFrame:
    """stats with pruned and prune_reason: scope_range is tested before time_range."""
    scope, early, late = F.lit(False), F.lit(False), F.lit(False)
    if q.scope_id is not None:
        scope = (F.lit(q.scope_id) < F.col("scope_min")) | (F.lit(q.scope_id) > F.col("scope_max"))
    if q.time_start is not None:
        early = F.col("time_max") < F.lit(q.time_start)
    if q.time_end is not None:
        late = F.col("time_min") > F.lit(q.time_end)
    reason = F.when(scope, "scope_range").when(early | late, "time_range")
    return stats.withColumn("prune_reason", reason).withColumn("pruned", reason.isNotNull())


def unshadowed(records: DataFrame, shadow: DataFrame) -> DataFrame:
    """records whose record_id isn't in shadow: ids deleted or newer in the memory tier."""
    return records.join(shadow.select("record_id").distinct(), "record_id", "left_anti")


def stray_candidates(candidates: DataFrame, upstream: DataFrame) -> DataFrame:
    """Candidates (segment_id, local_id) that aren't among the upstream rows; a valid generator has none."""
    return candidates.join(upstream, ["segment_id", "local_id"], "left_anti")


def refused(candidates: DataFrame, upstream: DataFrame) -> DataFrame:
    """candidates, each once; a query over them fails if one isn't among the upstream rows."""
    known = upstream.select("segment_id", "local_id", F.lit(True).alias("__known"))
    both = candidates.distinct().join(known, ["segment_id", "local_id"], "left")
    stray = F.raise_error(F.concat(F.lit("a generator proposed a record that the filters dropped: "), F.col("segment_id").cast("string"), F.lit("/"), F.col("local_id").cast("string")))
    return both.select(F.when(F.col("__known"), F.col("segment_id")).otherwise(stray.cast("long")).alias("segment_id"), "local_id")


def posted(postings: DataFrame, symbols: list[str]) -> DataFrame:
    """segment_id and local_id of the records that have all symbols, by intersecting their lists."""
    wanted = list(dict.fromkeys(normal_symbol_py(s) for s in symbols))
    lists = postings.where(F.col("symbol").isin(wanted)).groupBy("segment_id").agg(F.collect_list("local_ids").alias("lists"))
    common = F.aggregate(F.slice("lists", F.lit(2), F.lit(len(wanted))), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return lists.where(F.size("lists") == len(wanted)).select("segment_id", F.explode(common).alias("local_id"))


def postings(records: DataFrame) -> DataFrame:
    """segment_id, symbol, records, local_ids (sorted): the inverted lists of normal symbols.

    A list is as long as a segment at most, which bounds each group.
    """
    flat = records.select("segment_id", "local_id", F.explode(F.array_distinct("symbols")).alias("symbol"))
    return flat.groupBy("segment_id", "symbol").agg(F.count("*").alias("records"), F.sort_array(F.collect_list("local_id")).alias("local_ids"))
