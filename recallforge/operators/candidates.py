"""Candidate generators: which of a segment's filtered records are scored exactly.

A generator takes the filtered records and the query and returns (segment_id, local_id) pairs that are
among them. Own generators implement CandidateGenerator.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, functions as F

from ..functions.distance import l2_squared
from .filters import RecallQuery
from .topk import best_per

DEFAULT_BUDGET = 128


class CandidateGenerator(ABC):
    name = "custom"
    #: Whether candidates are known to be among the filtered records; those of others are checked.
    trusted = False

    @abstractmethod
    def candidates(self, records: DataFrame, query: RecallQuery) -> DataFrame:
        """segment_id and local_id of the candidates."""


def budget_of(query: RecallQuery) -> int:
    """The query's budget, or 128, doubled above confidence 0.8 and halved below 0.5; the limit at least."""
    if query.candidate_budget is not None:
        return max(query.candidate_budget, 1)
    c, n = query.min_confidence, DEFAULT_BUDGET
    n = n * 2 if c is not None and c > 0.8 else n // 2 if c is not None and c < 0.5 else n
    return max(n, query.top)


class Flat(CandidateGenerator):
    """The first `budget` records of each segment by local id; all without a budget."""

    name, trusted = "flat", True

    def candidates(self, records: DataFrame, query: RecallQuery) -> DataFrame:
        rows = records.select("segment_id", "local_id")
        if query.candidate_budget is None:
            return rows
        return best_per(rows, ["segment_id"], [F.asc("local_id")], max(query.candidate_budget, 1)).select("segment_id", "local_id")


class ArrayLike(CandidateGenerator):
    """The nearest `budget` records of each segment by squared distance, ties by local id."""

    name, trusted = "array_like", True

    def candidates(self, records: DataFrame, query: RecallQuery) -> DataFrame:
        if query.embedding is None:
            return Flat().candidates(records, query)
        if query.candidate_budget is None:
            return records.select("segment_id", "local_id")
        rows = records.select("segment_id", "local_id", l2_squared(F.col("embedding"), [float(x) for x in query.embedding]).alias("sq"))
        return best_per(rows, ["segment_id"], [F.asc("sq"), F.asc("local_id")], max(query.candidate_budget, 1)).select("segment_id", "local_id")
