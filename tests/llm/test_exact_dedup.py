import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from recallforge.llm import exact_dedup, queries
from . import odd


def brute(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), m == best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert got(queries.op7_exact_dedup(spark, data)) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *a: odd.frame(spark))
    assert got(queries.op7_exact_dedup(spark, "")) == brute([r[:2] for r in odd.ROWS])
    monkeypatch.setattr(queries, "table", lambda *a: odd.frame(spark, []))
    assert got(queries.op7_exact_dedup(spark, "")) == []


def test_negative_and_extreme_ids(spark):
    rows = [(-5, "a"), (3, "a"), (2**63 - 1, "b"), (-(2**63), "b"), (None, "c"), (9, "c"), (1, "d d"), (0, "dd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.duplicates(df).where("kept").collect()) == sorted([(-5, -5), (-(2**63),) * 2, (9, 9), (1, 1)])


def test_drop_copies_keeps_whole_rows(spark):
    df = odd.frame(spark)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(kept.select("doc_id").toPandas()["doc_id"].dropna()) == sorted(d for d, _, _, k, _ in brute([r[:2] for r in odd.ROWS]) if k and d is not None)


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(2000).selectExpr("xxhash64(id) AS key")
    own = [r.key % 2**64 for r in keys.collect()]
    found = exact_dedup.build_directory(keys, 100).collect()
    assert sum(r.entries for r in found) == 2000 and min(r.depth for r in found) > 0
    for r in found:
        inside = lambda d, c: sum(k >> (64 - d) == c for k in own)
        assert inside(r.depth, r.code) == r.entries <= 100
        assert inside(r.depth - 1, r.code >> 1) > 100  # the bucket it was split from was overfull


def test_directory_stays_small(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "DIRECTORY", 8)
    keys = spark.range(3000).selectExpr("xxhash64(id) AS key")
    assert 8 <= exact_dedup.build_directory(keys, 1).count() <= 32


def test_query_goes_through_split_buckets(spark, data, monkeypatch):
    """With small buckets the result is the same; without the directory's buckets there is none."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    monkeypatch.setattr(exact_dedup.duplicates, "__defaults__", (4,))
    made = []
    build = exact_dedup.build_directory
    monkeypatch.setattr(exact_dedup, "build_directory", lambda *a: made.append(build(*a)) or made[-1])
    assert got(queries.op7_exact_dedup(spark, data)) == brute(rows)
    assert made[0].agg({"depth": "min"}).first()[0] > 2
    monkeypatch.setattr(exact_dedup, "build_directory", lambda *a: build(*a).where("code % 2 = 0"))
    assert 0 < queries.op7_exact_dedup(spark, data).count() < len(rows)


def test_one_lookup_serves_all_depths(spark):
    """Buckets of several depths, three of them as deep as a directory goes: each key finds its own."""
    shape = "depth int, code long"
    even = [(1, 0), (2, 2), (4, 12), (4, 13), (5, 28), (5, 29)]
    deep = [(64, 5), (64, -1), (64, 2**63 - 1), (40, 7), (20, 2**20 - 2)]
    keys = [0, 5, 7 << 24, (7 << 24) + 99, 2**62, 2**63 - 1, -(2**63), -(2**62), -1, -2, -(1 << 44) - 3, *(-(i << 59) for i in range(1, 9))]
    for own in (even, deep, [(0, 0)], []):
        want = {}
        for k in keys:
            at = [c << (64 - d) for d, c in own if (k % 2**64) >> (64 - d) == c % 2**d]
            want[k] = at[0] if at else None  # buckets do not overlap
        buckets = spark.createDataFrame(own, shape)
        rows = spark.createDataFrame([(k,) for k in keys], "key long")
        signed = lambda b: None if b is None else (b + 2**63) % 2**64 - 2**63
        found = exact_dedup.routed(rows, buckets)
        assert {r.key: r.bucket for r in found.collect()} == {k: signed(b) for k, b in want.items()}
        if own == even:
            assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert exact_dedup._levels({9: 400, 10: 200, 11: 30}) == [[9, 10, 11]]
    assert exact_dedup._levels({15: 30000, 16: 4000, 17: 1000, 40: 3}) == [[15, 16, 17], [40]]


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    rows = [(i, f"{i % 7} x") for i in range(40)] + [(50, "7x"), (51, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hashed in (lambda norm: F.lit(5).cast("long"), lambda norm: F.shiftleft(F.length(norm).cast("long"), 62)):
        monkeypatch.setattr(exact_dedup, "hashed", hashed)
        found = exact_dedup.duplicates(df, 2)
        assert got(found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")) == brute(rows)


def test_rows_of_clashing_names_come_back_whole(spark):
    names = "doc_id long, text string, own int, id int, none int, sha int, points int, __d int"
    df = spark.createDataFrame([(1, "a b", 1, 2, 3, 4, 5, 77), (2, "ab", 1, 2, 3, 4, 5, 78)], names)
    assert [tuple(r) for r in exact_dedup.drop_copies(df).collect()] == [(1, "a b", 1, 2, 3, 4, 5, 77)]
