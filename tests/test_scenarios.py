"""Recall against plain scans: scenarios of selective filters, look-alike vectors, ties and random records."""

import json
import random

import pytest

from recallforge.operators.filters import RecallQuery
from recallforge.operators.recall import recall
from recallforge.plans.planner import Planner
from recallforge.research import baselines
from recallforge.schema import RECORD, STORED, checked
from recallforge.session import prepare


def rec(i, seg, scope, time, conf, vec, symbols, **more):
    return {"segment_id": seg, "record_id": i, "scope_id": scope, "timestamp": time, "source_id": 1, "confidence": conf, "text": f"record {i}", "embedding": vec, "symbols": symbols, "vector_id": None, "metadata": {}, **more}


def frame(spark, records):
    rows = spark.createDataFrame([tuple(r[f.name] for f in [STORED["segment_id"], *RECORD.fields]) for r in records], "segment_id long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD.fields))
    return checked(rows, None, "segment_id").selectExpr("segment_id", "cast(record_id as int) as local_id", *[f.name for f in RECORD.fields])


SCENARIOS = {
    "filters leave one": (
        [rec(1, 10, 41, 110, 0.97, [0.9, 0.1], ["m", "hit"]), rec(2, 10, 42, 111, 0.99, [0.9, 0.1], ["m"]), rec(3, 11, 41, 900, 0.98, [0.9, 0.1], ["m"]), rec(4, 11, 41, 112, 0.5, [0.9, 0.1], ["m"])],
        RecallQuery([0.9, 0.1], ["M", "hit"], 41, 100, 199, 0.9, 3, 16), [1],
    ),
    "a rare symbol decides": (
        [rec(1, 20, 5, 1, 0.9, [0.2, 0.8], ["s", "rare"]), rec(2, 20, 5, 2, 0.99, [0.2, 0.8], ["s"]), rec(3, 21, 6, 3, 0.9, [0.2, 0.8], ["rare"])],
        RecallQuery([0.2, 0.8], ["rare"], 5, limit=3), [1],
    ),
    "no filters": ([rec(i, i % 2, i, i, 0.9, [i * 1.0, 0.0], ["x"]) for i in range(5)], RecallQuery([2.2, 0.0], limit=3), [2, 3, 1]),
    "equal vectors, wrong tokens": (
        [rec(1, 50, 3, 1, 0.9, [0.7, 0.1], ["a", "b", "c"]), rec(2, 50, 3, 1, 0.99, [0.7, 0.1], ["a", "x"]), rec(3, 51, 3, 1, 0.99, [0.7, 0.1], ["a", "c"]), rec(4, 51, 4, 1, 1.0, [0.7, 0.1], ["a", "b", "c"])],
        RecallQuery([0.7, 0.1], ["a", "b", "c"], 3), [1],
    ),
    "a route misses, the answer is found": (
        [rec(i, 72, 1, i, 0.9, [float(i), 0.0], ["needle"] if i == 127 else ["hay"]) for i in range(128)],
        RecallQuery([0.0, 0.0], ["needle"], candidate_budget=1, limit=1), [127],
    ),
    "ties by segment, then record": ([rec(9, 1, 1, 1, 0.5, [0.0], []), rec(4, 2, 1, 1, 0.5, [0.0], []), rec(3, 2, 1, 1, 0.5, [0.0], [])], RecallQuery(limit=5), [9, 3, 4]),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario(spark, name):
    records, query, want = SCENARIOS[name]
    rows = frame(spark, records)
    assert [i for i, _ in baselines.scan(records, query)] == want
    assert [r.record_id for r in recall(rows, query).collect()] == want
    assert [r.record_id for r in recall(rows, query, Planner()).collect()] == want


def test_random_records(spark):
    prepare(spark)
    rng = random.Random(7)
    records = [rec(i, rng.randrange(4), rng.randrange(3), rng.randrange(50), rng.randrange(8) / 8, [rng.randrange(4) / 2 for _ in range(3)], rng.sample(["a", "B ", "c", "d"], rng.randrange(4)), metadata={"k": rng.choice("xy")}, vector_id=rng.choice([None, "v"])) for i in range(150)]
    rows = frame(spark, records).cache()
    for _ in range(12):
        q = RecallQuery(
            rng.choice([None, [0.5, 1.0, 0.0]]), rng.sample(["A", "b"], rng.randrange(3)), rng.choice([None, 1]), rng.choice([None, 10]), rng.choice([None, 40]),
            rng.choice([None, 0.5]), rng.randrange(1, 9), None, rng.choice([None, None, "v"]), rng.choice([{}, {"k": "x"}]),
        )
        got = [(r.record_id, round(r.score, 6)) for r in recall(rows, q).collect()]
        assert got == [(i, round(s, 6)) for i, s in baselines.scan(records, q)], q
    lines = [json.dumps(r) for r in records]
    assert baselines.scan_jsonl([*lines, ""], RecallQuery()) == baselines.scan(records, RecallQuery())
    assert len(baselines.vectors_only(records, [0.5, 1.0, 0.0], 5)) == 5
