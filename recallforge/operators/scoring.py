"""Scores of records for a query: minus distance, plus symbol matches, distinct symbols and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.distance import l2_squared
from .filters import RecallQuery

MATCH_WEIGHT, SYMBOL_WEIGHT = 2.0, 0.01


def symbol_matches(q: RecallQuery) -> Column:
    """How many of the query's symbols (repeats count) the record has."""
    total = F.lit(0)
    for s in q.normal:
        total = total + F.array_contains("symbols", F.lit(s)).cast("int")
    return total


def semantic_distance(q: RecallQuery, squared: bool = False) -> Column:
    """L2 distance to the query; 0 without a query embedding. `squared` leaves out the root."""
    if q.embedding is None:
        return F.lit(0.0)
    d = l2_squared(F.col("embedding"), [float(x) for x in q.embedding])
    return d if squared else F.sqrt(d)


def scored(records: DataFrame, q: RecallQuery, squared: bool = False) -> DataFrame:
    """records with semantic_distance, symbol_matches and score. A record of another dimension fails."""
    if q.embedding is not None:
        ok = F.size("embedding") == len(q.embedding)
        records = records.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit("embedding of another dimension than the query's"))))
    rows = records.withColumns({"semantic_distance": semantic_distance(q, squared), "symbol_matches": symbol_matches(q)})
    score = -F.col("semantic_distance") + MATCH_WEIGHT * F.col("symbol_matches") + SYMBOL_WEIGHT * F.size(F.array_distinct("symbols")) + F.col("confidence").cast("double")
    return rows.withColumn("score", score)
