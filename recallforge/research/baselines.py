"""Plain scans for comparison with recall: records in a list or in a file, filters and scores row by row."""

from __future__ import annotations

import json
import math

from ..operators.filters import RecallQuery
from ..operators.scoring import MATCH_WEIGHT, SYMBOL_WEIGHT
from ..schema import normal_symbol_py


def passes(r: dict, q: RecallQuery) -> bool:
    own = {normal_symbol_py(s) for s in r["symbols"]}
    return (
        (q.scope_id is None or r["scope_id"] == q.scope_id)
        and (q.time_start is None or r["timestamp"] >= q.time_start)
        and (q.time_end is None or r["timestamp"] <= q.time_end)
        and (q.min_confidence is None or r["confidence"] >= q.min_confidence)
        and (q.vector_id is None or r.get("vector_id") == q.vector_id)
        and all((r.get("metadata") or {}).get(k) == v for k, v in q.metadata_filter.items())
        and set(q.normal) <= own
    )


def score(r: dict, q: RecallQuery) -> float:
    own = {normal_symbol_py(s) for s in r["symbols"]}
    far = 0.0 if q.embedding is None else math.sqrt(sum((a - b) ** 2 for a, b in zip(r["embedding"], q.embedding, strict=True)))
    return -far + MATCH_WEIGHT * sum(s in own for s in q.normal) + SYMBOL_WEIGHT * len(own) + r["confidence"]


def scan(records: list[dict], q: RecallQuery) -> list[tuple[int, float]]:
    """(record_id, score) of the best `limit` records; ties by segment, then record."""
    found = [(-score(r, q), r.get("segment_id", 0), r["record_id"]) for r in records if passes(r, q)]
    return [(i, -s) for s, _, i in sorted(found)[: q.top]]


def scan_jsonl(lines, q: RecallQuery) -> list[tuple[int, float]]:
    """The same over lines of JSON; blank ones are skipped."""
    return scan([json.loads(x) for x in lines if x.strip()], q)


def vectors_only(records: list[dict], embedding: list[float], k: int) -> list[int]:
    """record_id of the k nearest records, filters and symbols left aside."""
    near = [(sum((a - b) ** 2 for a, b in zip(r["embedding"], embedding, strict=True)), r["record_id"]) for r in records]
    return [i for _, i in sorted(near)[:k]]
