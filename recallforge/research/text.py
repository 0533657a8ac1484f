"""Embeddings and symbols from text: TF-IDF with a seeded projection; symbols of steps and files."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

TOKEN = r"[a-z]{3,15}"
#: Words that don't count (fixed values).
STOP = ["the", "a", "of", "and", "to", "in", "is", "that", "it", "on", "for", "with", "as", "was", "at", "by", "an"]


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id and words: runs of 3 to 15 ASCII letters in lower case, without STOP."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\b(" + TOKEN + r")\b"), F.lit(1))
    return docs.select("doc_id", F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda w: ~w.isin(STOP)).alias("words"))


def tfidf(docs: DataFrame) -> DataFrame:
    """doc_id, term, weight: share of the document's words times ln((N + 1) / (df + 1)) + 1, scaled to length 1, over
    all terms. Frequencies are joined by term, which Spark broadcasts only where they are few."""
    words = tokens(docs)
    n = words.count()
    counts = words.select("doc_id", F.size("words").alias("total"), F.explode("words").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("total").alias("total"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    weighed = counts.join(df, "term").withColumn("w", F.col("tf") / F.col("total") * (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0))
    norm = weighed.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def project(weights: DataFrame, dim: int = 128, seed: int = 42) -> DataFrame:
    """doc_id and embedding: Gaussian random projection of TF-IDF vectors, length 1. A term's direction
    follows from the seed and the term, so every partition uses the same."""
    uniform = lambda salt, pos: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "term", pos), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    normal = lambda pos: F.sqrt(-2 * F.log(uniform(1, pos))) * F.cos(F.lit(2 * np.pi) * uniform(2, pos))
    rows = weights.select("doc_id", array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda pos: F.col("weight") * normal(pos))).alias("v"))
    sums = rows.groupBy("doc_id").agg(Summarizer.sum(F.col("v")).alias("v"))
    vectors = sums.select("doc_id", vector_to_array("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return vectors.select("doc_id", F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float")).alias("embedding"))


def step_symbols(steps: DataFrame) -> DataFrame:
    """steps (path, kind, source) with symbols: file name, extension, kind, source."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    parts = F.array(F.nullif(name, F.lit("")), F.nullif(F.lower(ext), F.lit("")), "kind", "source")
    return steps.withColumn("symbols", F.array_distinct(F.array_compact(parts)))
