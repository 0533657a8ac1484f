"""Segments: immutable Parquet folders, written once, checked by count and fingerprint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import STORED, finite, normal_symbols, with_local_ids
from .manifest import SegmentRef


def fingerprint(records: DataFrame) -> DataFrame:
    """One row: n, dim, fingerprint, and the bounds that prune; order of rows doesn't matter."""
    row = F.xxhash64("record_id", "scope_id", "timestamp", "source_id", "confidence", "text", "embedding", "symbols", "vector_id", F.to_json("metadata"))
    return records.agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"),
        F.concat_ws(":", F.count("*"), F.sum(row.cast("decimal(38,0)")).cast("string"), F.bit_xor(row).cast("string")).alias("fingerprint"),
        F.min("scope_id").alias("scope_min"), F.max("scope_id").alias("scope_max"), F.min("timestamp").alias("time_min"), F.max("timestamp").alias("time_max"),
    )


def write(records: DataFrame, path: str, segment_id: int) -> SegmentRef:
    """Write checked records as one segment; all embeddings must have one length."""
    rows = with_local_ids(records.withColumn("segment_id", F.lit(segment_id).cast("long"))).select(*[f.name for f in STORED.fields])
    rows.drop("segment_id").sortWithinPartitions("scope_id", "timestamp").write.parquet(path)
    stats = fingerprint(records.sparkSession.read.parquet(path)).first()
    return SegmentRef(segment_id, path, stats.n, stats.dim, stats.fingerprint, stats.scope_min, stats.scope_max, stats.time_min, stats.time_max)


def read(spark: SparkSession, refs: list[SegmentRef], verify: bool = False) -> DataFrame:
    """The records of the segments, with segment_id. `verify` compares counts and fingerprints first.

    Only the segments given are listed, so pruned ones cost nothing.
    """
    parts = []
    for r in refs:
        rows = spark.read.schema(STORED).parquet(r.path).withColumn("segment_id", F.lit(r.segment_id).cast("long"))
        if verify:
            found = fingerprint(spark.read.parquet(r.path)).first()
            if (found.n, found.fingerprint) != (r.n, r.fingerprint):
                raise ValueError(f"segment {r.segment_id} isn't what its manifest says")
        parts.append(rows)
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], STORED)


def violations(records: DataFrame) -> DataFrame:
    """segment_id, rule, rows: broken layout rules, an empty result for sound segments."""
    dims = records.groupBy("segment_id").agg(F.max(F.size("embedding")).alias("__dim"))
    rows = records.join(dims, "segment_id")
    rules = {
        "record_id": F.col("record_id").isNotNull() & (F.col("record_id") >= 0), "dimension": F.size("embedding") == F.col("__dim"),
        "finite": F.forall("embedding", finite) & finite(F.col("confidence")), "symbols": F.col("symbols") == normal_symbols(F.col("symbols")),
        "local_id": F.col("local_id").isNotNull() & (F.col("local_id") >= 0), "metadata": F.col("metadata").isNotNull(),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return rows.select("segment_id", F.explode(broken).alias("rule")).groupBy("segment_id", "rule").agg(F.count("*").alias("rows"))
