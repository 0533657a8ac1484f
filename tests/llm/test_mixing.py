import re
from collections import Counter, defaultdict

import duckdb
import pytest

from recallforge.llm import mixing, queries
from . import odd


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """sizes: source to words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, full = share * sum(sizes.values()), set()
    while True:
        left = goal - sum(most * sizes[s] for s in full)
        total = sum(w[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / total for s in order}
        more = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not more:
            return target
        full |= more


def check(rows, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
    target = brute_targets(sizes)
    by_id = {d[0]: d for d in docs}
    assert len(rows) == len(docs)
    taken = defaultdict(int)
    for r in rows:
        d = by_id[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
        assert r.source_size == sizes[d[3]] and r.target == pytest.approx(target[d[3]], abs=1e-3)
        assert 0 <= r.taken <= 2 * r.size
        taken[d[3]] += r.taken
    return taken, target


def test_documents(spark, data):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = queries.op5_mixing(spark, data).collect()
    taken, target = check(rows, docs)
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.2)
    assert sorted(rows) == sorted(queries.op5_mixing(spark, data).collect())


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *a: odd.frame(spark))
    check(queries.op5_mixing(spark, "").collect(), [r[:4] for r in odd.ROWS])
    monkeypatch.setattr(queries, "table", lambda *a: odd.frame(spark, []))
    assert queries.op5_mixing(spark, "").count() == 0


def test_mix_repeats_rows_as_assigned(spark):
    docs = odd.frame(spark)
    copies = Counter()
    for r in mixing.assign(docs).collect():
        copies[r.doc_id] += r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +copies


def test_a_rate_of_two_takes_all_twice(spark):
    rows = [(i, "a b c", "en", "small" if i < 3 else "z") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.assign(df).collect()
    assert {r.copies for r in got if r.source == "small"} == {2}
    assert sum(r.copies for r in got) == pytest.approx(600, rel=0.1)


def test_sql_agrees(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.execute("SELECT doc_id, taken FROM (" + queries.ORACLE_SQL["op5_mixing"] + ")").fetchall()
    assert sorted(want) == sorted((r.doc_id, r.taken) for r in queries.op5_mixing(spark, data).collect())
