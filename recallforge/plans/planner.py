"""Adaptive choice of the access path, segment by segment, inside one plan.

The ladder, per segment: no survivors; no query embedding (first `budget` by local id); few survivors
(all of them); a tangent-tree or pivot-prefix route where one is enabled and the segment is large
enough; else the nearest `budget`. A route that reports fallback or finds too little is widened to the
nearest of a doubled budget. Survivors are counted by one aggregation whose result stays distributed;
only segments on a routed path go through Python, a segment at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.distance import l2_squared
from ..operators.candidates import CandidateGenerator, budget_of
from ..operators.filters import RecallQuery
from ..operators.topk import best_per
from ..routers.blocks import GUARD
from ..session import prepare

DIRECT_AT_MOST = 256


@dataclass
class PlannerConfig:
    tangent: bool = True
    pivot: bool = True
    tangent_min_rows: int = 256
    pivot_min_rows: int = 256
    direct_at_most: int = DIRECT_AT_MOST
    #: Survivors of a segment up to which a router is built; larger ones take the nearest by distance.
    route_at_most: int = GUARD


def widened(budget: int, n: int) -> int:
    return min(max(2 * budget, budget + 1 if budget < n else budget), n)


def plan(records: DataFrame, query: RecallQuery, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """segment_id, survivors, selected_path, candidate_budget of each segment with survivors."""
    n = records.groupBy("segment_id").agg(F.count("*").alias("survivors"), F.max(F.col("cold")).alias("cold") if "cold" in records.columns else F.lit(False).alias("cold"))
    budget = F.least(F.lit(budget_of(query)).cast("long"), F.col("survivors"))
    small = F.col("survivors") <= config.route_at_most
    path = (
        F.when(F.col("cold"), "direct_rerank")
        .when(F.lit(query.embedding is None), "missing_embedding")
        .when(F.col("survivors") <= config.direct_at_most, "direct_rerank")
        .when(F.lit(config.tangent) & small & (F.col("survivors") >= config.tangent_min_rows), "tangent")
        .when(F.lit(config.pivot) & small & (F.col("survivors") >= config.pivot_min_rows), "pivot_prefix")
        .otherwise("array_like")
    )
    return n.select("segment_id", "survivors", path.alias("selected_path"), F.when(path == "direct_rerank", F.col("survivors")).otherwise(budget).alias("candidate_budget"))


class Planner(CandidateGenerator):
    name, trusted = "planner", True

    def __init__(self, config: PlannerConfig = PlannerConfig()):
        self.config = config

    def traced(self, records: DataFrame, query: RecallQuery) -> DataFrame:
        """segment_id, local_id, selected_path, fallback_reason, expanded_candidate_budget."""
        prepare(records.sparkSession)
        paths = plan(records, query, self.config)
        rows = records.join(paths, "segment_id")
        none = F.lit(None).cast("string").alias("fallback_reason"), F.lit(None).cast("long").alias("expanded_candidate_budget")
        out = ["segment_id", "local_id", "selected_path"]
        direct = rows.where("selected_path = 'direct_rerank'").select(*out, *none)
        first = best_per(rows.where("selected_path = 'missing_embedding'").select(*out, "candidate_budget"), ["segment_id"], [F.asc("local_id")], F.col("candidate_budget")).select(*out, *none)
        found = direct.unionAll(first)
        if query.embedding is None:
            return found
        e = [float(x) for x in query.embedding]
        near = rows.where("selected_path = 'array_like'").select(*out, "candidate_budget", l2_squared(F.col("embedding"), e).alias("sq"))
        near = best_per(near, ["segment_id"], [F.asc("sq"), F.asc("local_id")], F.col("candidate_budget")).select(*out, *none)
        confidence = query.min_confidence

        def route(pdf: pd.DataFrame) -> pd.DataFrame:
            from ..routers import pivot, tangent

            pdf = pdf.sort_values("local_id")
            x, q = np.array(pdf["embedding"].tolist(), float), np.array(e)
            path, budget, n = pdf["selected_path"].iloc[0], int(pdf["candidate_budget"].iloc[0]), len(pdf)
            if path == "tangent":
                r = tangent.build_for_segment(x)
                nprobe = r.config.final_nprobe
                nprobe = nprobe * 2 if confidence is not None and confidence > 0.8 else max(1, nprobe // 2) if confidence is not None and confidence < 0.5 else nprobe
                got, fallback = r.route(q, final_nprobe=min(nprobe, n))
            else:
                got, fallback = pivot.build_for_segment(x).route(q)[:2]
            got, reason, wide = got[: min(budget, n)], None, None
            if fallback or not len(got) or len(got) < min((budget + 1) // 2, n):
                reason, wide = "route_fallback" if fallback else "empty_vector_candidates" if not len(got) else "too_few_candidates", widened(budget, n)
                d = ((x - q) ** 2).sum(axis=1)
                got = np.lexsort((np.arange(n), d))[:wide]
            part = pdf.iloc[np.sort(got)][["segment_id", "local_id", "selected_path"]].copy()
            part["fallback_reason"], part["expanded_candidate_budget"] = reason, wide
            return part.astype({"expanded_candidate_budget": "Int64"})

        routed = rows.where(F.col("selected_path").isin("tangent", "pivot_prefix")).select("segment_id", "local_id", "selected_path", "candidate_budget", "embedding")
        shape = "segment_id long, local_id int, selected_path string, fallback_reason string, expanded_candidate_budget long"
        return found.unionAll(near).unionAll(routed.groupBy("segment_id").applyInPandas(route, shape))

    def candidates(self, records: DataFrame, query: RecallQuery) -> DataFrame:
        return self.traced(records, query).select("segment_id", "local_id")
