"""Canonical schemas, checks at ingest, and the records view over the sample tables.

Ids are signed 64-bit; hashes that use all 64 bits are DECIMAL(20,0). Embeddings are stored as
floats and computed with as doubles. NaN and infinite numbers are refused at ingest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

HASH = T.DecimalType(20, 0)

_KINDS = {
    "record_id": T.LongType(), "scope_id": T.LongType(), "timestamp": T.LongType(), "source_id": T.IntegerType(), "confidence": T.FloatType(), "text": T.StringType(),
    "embedding": T.ArrayType(T.FloatType()), "symbols": T.ArrayType(T.StringType()), "vector_id": T.StringType(), "metadata": T.MapType(T.StringType(), T.StringType()),
}
RECORD = T.StructType([T.StructField(k, v) for k, v in _KINDS.items()])
STORED = T.StructType([T.StructField("segment_id", T.LongType()), T.StructField("local_id", T.IntegerType()), *RECORD.fields])
OPLOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("record_id", T.LongType()), T.StructField("record", RECORD), T.StructField("checksum", HASH)])
HIT_COLUMNS = ["rank", "record_id", "score", "semantic_distance", "symbol_matches", "confidence", "timestamp", "text", "vector_id", "metadata"]
REQUIRED = ("record_id", "scope_id", "timestamp", "source_id", "confidence", "text", "embedding", "symbols")


def normal_symbol(symbol: Column) -> Column:
    """Unicode blanks trimmed, A-Z in lower case; other letters stay."""
    trimmed = F.regexp_replace(symbol, r"(?U)^\s+|\s+$", "")
    return F.translate(trimmed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal_symbols(symbols: Column) -> Column:
    """Normal form of each, without repeats and nulls, sorted."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(F.coalesce(symbols, F.array().cast("array<string>")), normal_symbol), lambda s: s.isNotNull())))


def normal_symbol_py(symbol: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in symbol.strip())


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def checked(records: DataFrame, dim: int | None = None, *also: str) -> DataFrame:
    """records in the canonical schema (after the columns named in `also`) with normal symbols; a row
    that breaks a rule fails the job."""
    for name in ("vector_id", "metadata"):
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast(RECORD[name].dataType))
    missing = [c for c in REQUIRED if c not in records.columns]
    if missing:
        raise ValueError(f"records lack {', '.join(missing)}")
    rows = records.select(*also, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD.fields])
    size = F.lit(dim) if dim else F.size("embedding")
    ok = (
        F.col("record_id").isNotNull() & (F.col("record_id") >= 0) & F.col("scope_id").isNotNull() & finite(F.col("confidence"))
        & (F.size("embedding") > 0) & (F.size("embedding") == size) & F.forall("embedding", finite)
    )
    guard = F.when(ok, F.col("record_id")).otherwise(F.raise_error(F.concat(F.lit("invalid record "), F.coalesce(F.col("record_id").cast("string"), F.lit("null")))).cast("bigint"))
    none = F.create_map().cast("map<string,string>")
    return rows.withColumns({"record_id": guard, "symbols": normal_symbols(F.col("symbols")), "metadata": F.coalesce("metadata", none)})


def with_local_ids(records: DataFrame) -> DataFrame:
    """records with local_id, the place of a record in its segment by record_id."""
    from pyspark.sql import Window

    return records.withColumn("local_id", (F.row_number().over(Window.partitionBy("segment_id").orderBy("record_id")) - 1).cast("int"))


def records_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample tables as memory records: documents with an embedding, symbols and metadata each."""
    docs, emb, lab = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings", "labels"))
    n = emb.count()
    rows = docs.withColumn("vec_id", F.col("doc_id") % n).join(emb.select("vec_id", "embedding"), "vec_id").join(lab.select("doc_id", "quality"), "doc_id", "left")
    scope = F.col("doc_id") % 32
    symbols = F.array("lang", "source", F.concat(F.lit("scope-"), scope.cast("string")), F.concat(F.lit("topic-"), F.expr("cast(div(doc_id, 17) % 64 as string)")))
    pairs = F.when(F.col("quality").isNull(), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).otherwise(
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("quality"), F.col("quality").cast("string"))
    )
    return rows.select(
        (F.col("doc_id") % 10).alias("segment_id"), F.expr("cast(div(doc_id, 10) as int)").alias("local_id"), F.col("doc_id").alias("record_id"), scope.alias("scope_id"),
        (F.lit(1700000000) + F.col("doc_id")).alias("timestamp"), F.expr("cast(substr(source, 4) as int)").alias("source_id"),
        F.expr("cast(0.70D + (doc_id % 30) * 0.01D as float)").alias("confidence"), "text", "embedding", symbols.alias("symbols"),
        F.when(F.col("quality").isNotNull(), F.concat(F.lit("vec-"), F.col("doc_id").cast("string"))).alias("vector_id"), pairs.alias("metadata"),
    )


#: The same view in DuckDB's SQL.
RECORDS_SQL = """
    records AS (
        SELECT d.doc_id % 10 AS segment_id, d.doc_id // 10 AS local_id, d.doc_id AS record_id, d.doc_id % 32 AS scope_id,
               1700000000 + d.doc_id AS "timestamp", CAST(substr(d.source, 4) AS INTEGER) AS source_id,
               CAST(CAST(0.70 AS DOUBLE) + (d.doc_id % 30) * CAST(0.01 AS DOUBLE) AS FLOAT) AS confidence, d.text, e.embedding,
               [d.lang, d.source, 'scope-' || (d.doc_id % 32), 'topic-' || ((d.doc_id // 17) % 64)] AS symbols,
               CASE WHEN l.doc_id IS NOT NULL THEN 'vec-' || d.doc_id END AS vector_id, d.lang, d.source, CAST(l.quality AS VARCHAR) AS quality
        FROM documents d CROSS JOIN (SELECT count(*) AS n FROM embeddings) c
        JOIN embeddings e ON e.vec_id = d.doc_id % c.n LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""
