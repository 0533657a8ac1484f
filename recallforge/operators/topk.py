"""Top-k in all its forms. Every order has a unique last key, so results are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def best(rows: DataFrame, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows and their rank; a TakeOrderedAndProject, no shuffle of the rest. The ranking
    window sees those k rows only."""
    top = rows.orderBy(*order).limit(k)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def best_per(rows: DataFrame, by: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group and their rank; Spark limits groups before the shuffle too."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def merge_order() -> list[Column]:
    """Order of hits over segments: score, then segment, then record."""
    return [F.desc("score"), F.asc("segment_id"), F.asc("record_id")]


def merge_unique(rows: DataFrame, by: list[str], key: str, order: list[Column], k: int) -> DataFrame:
    """Rows without repeats of key within each group, then the first k of each."""
    return best_per(best_per(rows, [*by, key], order, 1, "__first").drop("__first"), by, order, k)
