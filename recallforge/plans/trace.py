"""What a recall did, one row per segment, from one aggregation over the filtered records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.candidates import CandidateGenerator
from ..operators.filters import RecallQuery, column_predicate, matching, symbol_predicate

SHAPE = "segment_id long, pruned boolean, prune_reason string, records_total long, candidates_after_filters long, candidates_after_symbols long, vector_generator string, vector_candidates long, semantic_evals long, returned long, cold_bytes_read long, read_amplification double, access_paths array<string>"


def recall_trace(records: DataFrame, query: RecallQuery, generator: CandidateGenerator | None = None, pruned: dict[int, str] | None = None) -> DataFrame:
    """The trace of each segment, pruned ones included."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    passes, has = column_predicate(query), column_predicate(query) & symbol_predicate(query)
    cold = F.col("cold") if "cold" in records.columns else F.lit(False)
    counts = records.groupBy("segment_id").agg(F.count("*").alias("records_total"), n(F.coalesce(passes, F.lit(False))).alias("candidates_after_filters"), n(F.coalesce(has, F.lit(False))).alias("candidates_after_symbols"), F.max(cold).alias("cold"), F.max(F.size("embedding")).alias("dim"))
    if generator is None:
        counts = counts.withColumn("vector_candidates", F.col("candidates_after_symbols"))
    else:
        found = generator.candidates(matching(records, query), query).groupBy("segment_id").agg(F.count("*").alias("vector_candidates"))
        counts = counts.join(found, "segment_id", "left").fillna(0, ["vector_candidates"])
    recon = F.lit(query.fallback_to_recon_on_cold) & F.col("cold")
    evals = F.when(F.lit(query.embedding is None) | recon, 0).otherwise(F.col("vector_candidates"))
    returned = F.least("vector_candidates", F.lit(query.top))
    cold_bytes = F.when(F.col("cold") & ~recon & F.lit(query.embedding is not None), F.col("vector_candidates") * F.col("dim") * 4).otherwise(0)
    paths = F.array_compact(F.array(F.lit("column_filters"), F.when(F.lit(bool(query.symbols)), "symbol_postings"), F.when(F.lit(query.embedding is not None) & ~recon, "semantic_rerank"), F.when(recon, "fallback_to_recon")))
    needed = returned * F.col("dim") * 4
    amplification = F.when(recon, 0.0).when((cold_bytes > 0) & (needed > 0), cold_bytes / needed).otherwise(1.0)
    rows = counts.select(
        "segment_id", F.lit(False).alias("pruned"), F.lit(None).cast("string").alias("prune_reason"), "records_total", "candidates_after_filters", "candidates_after_symbols",
        F.lit(generator.name if generator else "all").alias("vector_generator"), "vector_candidates", evals.cast("long").alias("semantic_evals"), returned.cast("long").alias("returned"),
        cold_bytes.cast("long").alias("cold_bytes_read"), amplification.alias("read_amplification"), paths.alias("access_paths"),
    )
    if pruned:
        gone = [(s, True, why, *[0] * 3, "none", *[0] * 4, 1.0, []) for s, why in sorted(pruned.items())]
        rows = rows.unionAll(records.sparkSession.createDataFrame(gone, SHAPE))
    return rows
