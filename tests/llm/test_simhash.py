import re

import xxhash

from recallforge.llm import components, queries, simhash
from . import odd


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute(rows):
    """(doc_id, fingerprint, component_id) by comparing all pairs."""
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert got(queries.op3_simhash(spark, data)) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *a: odd.frame(spark))
    assert got(queries.op3_simhash(spark, "")) == brute([r[:2] for r in odd.ROWS])
    monkeypatch.setattr(queries, "table", lambda *a: odd.frame(spark, []))
    assert got(queries.op3_simhash(spark, "")) == []


def test_links_find_all_pairs_within_two_bits(spark):
    import random

    rng = random.Random(3)
    seeds = [rng.getrandbits(63) for _ in range(40)]
    fps = sorted({s ^ (1 << a) ^ (1 << b) for s in seeds for a, b in [(0, 0), (1, 5), (5, 9), (9, 1), (3, 60), (60, 61)]})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in components.connected_components(simhash.links(df)).collect()}
    root = {f: roots.get(f, f) for f in fps}
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    assert near and all(root[a] == root[b] for a, b in near)
    assert len(set(root.values())) == 40


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.root for r in components.connected_components(df).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}, 201: 200}


def test_keep_one_keeps_a_document_of_each_group(spark):
    df = odd.frame(spark)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    want = {c for d, _, c in brute([r[:2] for r in odd.ROWS]) if c is not None}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
