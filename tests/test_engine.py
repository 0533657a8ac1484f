import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallforge.functions import hashing, quantize, stats, zorder
from recallforge.index import grain, kmeans, shared_pq
from recallforge.index.buffer import WriteBuffer
from recallforge.index.index import GrainIndex, Options
from recallforge.operators import candidates, filters, knn, recall
from recallforge.operators.filters import RecallQuery
from recallforge.plans import planner
from recallforge.research import graphs, routers as more, text
from recallforge.routers import blocks, lattice, pivot, tangent
from recallforge.schema import STORED, checked, normal_symbol, normal_symbol_py
from recallforge.session import prepare
from recallforge.sources import cold, oplog, segments, vectors
from recallforge.sources.files import Files
from recallforge.sources.manifest import Manifest, SegmentRef, Sidecar, sidecar_problem
from recallforge.space import Collection, MemorySpace


def row(record_id, scope=7, time=100, conf=0.9, vec=(1.0, 0.0, 0.0), symbols=("alpha",), segment=1, local=None, vector_id=None, metadata=None):
    return (segment, record_id if local is None else local, record_id, scope, time, 1, conf, f"text {record_id}", [float(v) for v in vec], list(symbols), vector_id, metadata or {})


def frame(spark, rows):
    return spark.createDataFrame(rows, STORED)


def record(record_id, **more):
    r = row(record_id, **more)
    return {f.name: v for f, v in zip(STORED.fields, r) if f.name not in ("segment_id", "local_id")}


def ids(df):
    return [r.record_id for r in df.collect()]


# -- recall


def test_filters_and_order(spark):
    rows = frame(spark, [
        row(1, conf=0.9, vec=(1, 0, 0), symbols=["alpha", "beta"]), row(2, scope=8), row(3, time=200), row(4, conf=0.5), row(5, vec=(0, 1, 0), symbols=["alpha", "beta"], metadata={"k": "v"}, vector_id="x"),
    ])
    assert ids(recall.recall(rows, RecallQuery(scope_id=7, time_start=100, time_end=100, min_confidence=0.9))) == [1, 5]
    assert ids(recall.recall(rows, RecallQuery(symbols=[" ALPHA ", "Beta"], embedding=[0.0, 1.0, 0.0]))) == [5, 1]
    assert ids(recall.recall(rows, RecallQuery(metadata_filter={"k": "v"}))) == [5]
    assert ids(recall.recall(rows, RecallQuery(vector_id="x"))) == [5] and ids(recall.recall(rows, RecallQuery(symbols=["none"]))) == []
    assert len(ids(recall.recall(rows, RecallQuery(limit=0)))) == 1


def test_scores(spark):
    hit = recall.recall(frame(spark, [row(1, conf=0.5, vec=(3, 4, 0), symbols=["a", "b"])]), RecallQuery(embedding=[0.0, 0.0, 0.0], symbols=["a", "A"])).first()
    assert hit.semantic_distance == 5.0 and hit.symbol_matches == 2
    assert hit.score == pytest.approx(-5.0 + 4.0 + 0.02 + 0.5)


def test_merge_prefers_smaller_segment_and_memory_shadows(spark):
    rows = frame(spark, [row(9, segment=1), row(3, segment=2), row(4, segment=2)])
    assert ids(recall.recall(rows, RecallQuery(limit=3))) == [9, 3, 4]
    memory = frame(spark, [row(9, conf=0.95), row(20)]).drop("segment_id", "local_id")
    gone = spark.createDataFrame([(3,)], "record_id long")
    assert ids(recall.recall(rows, RecallQuery(limit=5), None, memory, gone)) == [9, 4, 20]
    strict = recall.recall(rows, RecallQuery(limit=1, embedding=[4.0, 0.0, 0.0]), None, memory, gone, strict_compat=True)
    assert strict.first().record_id == 9 and strict.first().semantic_distance == 9.0  # 4 was cut with the deleted 3


def test_other_dimension_fails(spark):
    with pytest.raises(Exception, match="dimension"):
        recall.recall(frame(spark, [row(1)]), RecallQuery(embedding=[1.0, 2.0])).collect()


def test_many_queries_equal_single_ones(spark):
    prepare(spark)
    rng = np.random.default_rng(1)
    rows = frame(spark, [row(i, scope=i % 3, time=i, conf=float(np.float32(0.5 + i % 7 / 20)), vec=rng.normal(size=3), symbols=["s%d" % (i % 4), "all"], segment=i % 5, metadata={"m": str(i % 2)}) for i in range(200)])
    queries = [(1, RecallQuery(embedding=[0.1, 0.2, 0.3], limit=7)), (2, RecallQuery(symbols=["S1", "all"], scope_id=1)), (3, RecallQuery(min_confidence=0.6, time_start=20, time_end=90, metadata_filter={"m": "1"}, limit=4)), (4, RecallQuery(symbols=["zzz"]))]
    many = {i: [] for i, _ in queries}
    for r in recall.recall_many(rows, queries).orderBy("query_id", "rank").collect():
        many[r.query_id].append((r.record_id, round(r.score, 9)))
    for i, q in queries:
        assert many[i] == [(r.record_id, round(r.score, 9)) for r in recall.recall(rows, q).collect()], i


def test_generators_and_budget(spark):
    rows = frame(spark, [row(i, vec=(i, 0, 0), local=i) for i in range(10)])
    q = RecallQuery(embedding=[9.0, 0.0, 0.0], candidate_budget=2, limit=5)
    assert ids(recall.recall(rows, q, candidates.Flat())) == [1, 0]
    assert ids(recall.recall(rows, q, candidates.ArrayLike())) == [9, 8]
    assert [candidates.budget_of(RecallQuery(min_confidence=c)) for c in (None, 0.9, 0.4)] == [128, 256, 64]
    stray = filters.stray_candidates(spark.createDataFrame([(1, 3), (1, 77)], "segment_id long, local_id int"), rows)
    assert [r.local_id for r in stray.collect()] == [77]


def test_planner_ladder(spark):
    rng = np.random.default_rng(2)
    rows = frame(spark, [row(i, vec=rng.normal(size=3), local=i, segment=1) for i in range(300)] + [row(1000 + i, vec=rng.normal(size=3), segment=2, local=i) for i in range(20)])
    q = RecallQuery(embedding=[0.0, 0.0, 0.0], candidate_budget=40)
    paths = {r.segment_id: (r.selected_path, r.candidate_budget) for r in planner.plan(rows, q).collect()}
    assert paths == {1: ("tangent", 40), 2: ("direct_rerank", 20)}
    assert {r.selected_path for r in planner.plan(rows, RecallQuery()).collect()} == {"missing_embedding"}
    off = planner.PlannerConfig(tangent=False)
    assert planner.plan(rows, q, off).where("segment_id = 1").first().selected_path == "pivot_prefix"
    for config in (planner.PlannerConfig(), off, planner.PlannerConfig(tangent=False, pivot=False)):
        got = planner.Planner(config).traced(rows, q)
        assert got.where("segment_id = 2").count() == 20
        n = got.where("segment_id = 1").count()
        assert 20 <= n <= 80 and filters.stray_candidates(got, rows).count() == 0
    assert planner.widened(10, 100) == 20 and planner.widened(60, 100) == 100


def test_trace(spark):
    rows = frame(spark, [row(1), row(2, scope=9), row(3, symbols=["b"], segment=2)])
    from recallforge.plans.trace import recall_trace

    got = {r.segment_id: r for r in recall_trace(rows, RecallQuery(scope_id=7, symbols=["alpha"], embedding=[0.0] * 3), None, {5: "time_range"}).collect()}
    assert (got[1].records_total, got[1].candidates_after_filters, got[1].candidates_after_symbols, got[1].returned) == (2, 1, 1, 1)
    assert got[2].candidates_after_symbols == 0 and got[5].pruned and got[5].prune_reason == "time_range"
    assert got[1].access_paths == ["column_filters", "symbol_postings", "semantic_rerank"]


def test_symbols_and_ingest_checks(spark):
    raw = ["  ÄbC ", "X\ty ", "plain"]
    df = spark.createDataFrame([(s,) for s in raw], "s string").select(normal_symbol(F.col("s")).alias("n"))
    assert [r.n for r in df.collect()] == [normal_symbol_py(s) for s in raw] == ["Äbc", "x\ty", "plain"]
    for bad in (row(-1), row(1, conf=float("nan")), row(1, vec=(float("inf"), 0, 0))):
        with pytest.raises(Exception, match="invalid record"):
            checked(frame(spark, [bad])).collect()
    assert checked(frame(spark, [row(1, symbols=[" B", "a", "b"])])).first().symbols == ["a", "b"]


def test_prune_reasons(spark):
    stats = filters.segment_stats(frame(spark, [row(1, scope=5, time=100), row(2, scope=9, time=200)]))
    reason = lambda **k: filters.prune(stats, RecallQuery(**k)).first().prune_reason
    assert reason(scope_id=4, time_start=500) == "scope_range" and reason(scope_id=7, time_start=201) == "time_range"
    assert reason(time_end=99) == "time_range" and reason(scope_id=9, time_start=200, time_end=300) is None


# -- storage


def test_collection_life(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    c = Collection(spark, root)
    c.insert_many([record(i, vec=(i, 0, 0), scope=i % 2) for i in range(6)])
    c.insert(record(3, vec=(30, 0, 0)))
    c.delete(1, 77)
    q = RecallQuery(embedding=[0.0, 0.0, 0.0], limit=10)
    before = [(r.record_id, round(r.score, 6)) for r in c.recall(q).collect()]
    assert sorted(i for i, _ in before) == [0, 2, 3, 4, 5] and c.space.is_deleted(1) and not c.space.is_deleted(2)
    with pytest.raises(RuntimeError, match="writer"):
        Collection(spark, root)
    c.close()
    c = Collection(spark, root)  # replayed from the log
    assert [(r.record_id, round(r.score, 6)) for r in c.recall(q).collect()] == before
    first = c.space.manifest.manifest_id
    c.flush()
    assert c.space.manifest.parent_manifest_id == first and len(c.space.manifest.segments) == 1
    assert [(r.record_id, round(r.score, 6)) for r in c.recall(q).collect()] == before
    child = c.space.fork("side", f"{root}/side.json")
    c.delete(0)
    c.insert(record(4, vec=(0, 0, 0)))
    c.flush()
    assert sorted(ids(c.recall(q))) == [2, 3, 4, 5] and c.get_record(4).first().embedding == [0.0, 0.0, 0.0]
    assert [s.segment_id for s in c.space.manifest.segments] == [1, 2] and c.get_record(0).count() == 0
    with MemorySpace(spark, root, f"{root}/side.json") as side:
        assert sorted(ids(side.recall(q))) == [0, 2, 3, 4, 5] and side.manifest.branch_id == hashing.branch_id("side") == child.branch_id
        side.delete(5)
        assert 5 in ids(c.recall(q)) and 5 not in ids(side.recall(q))
    assert c.space.collect_garbage() == 0
    c.space.segment_records().select("record_id").collect()
    c.close()


def test_automatic_flush_and_pruned_segments(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c", flush_at=3)
    for base in (0, 100):
        c.insert_many([record(base + i, scope=base, time=base) for i in range(3)])
    assert [s.n for s in c.space.manifest.segments] == [3, 3]
    keep, why = c.space.pruned(RecallQuery(scope_id=100, time_start=50))
    assert [s.segment_id for s in keep] == [2] and why == {1: "scope_range"}
    with pytest.raises(Exception, match="invalid record"):
        c.insert(record(9, vec=(1, 2)))
    c.close()


@pytest.mark.parametrize("encoding", ["raw", "f16", "sq8"])
def test_cold_vectors(spark, tmp_path, encoding):
    c = Collection(spark, f"file://{tmp_path}/c", vector_encoding=encoding)
    c.insert_many([record(i, vec=(i, 1, 0)) for i in range(1, 4)])
    c.flush()
    assert c.space.manifest.segments[0].tier == "cold" and c.space.resident_raw_dram_bytes() == 0
    q = RecallQuery(embedding=[1.0, 1.0, 0.0], limit=3)
    got = c.recall(q).collect()
    assert [r.record_id for r in got] == [1, 2, 3] and got[1].semantic_distance == pytest.approx(1.0, abs=0.05)
    t = c.trace(q).first()
    assert t.cold_bytes_read == 36 and t.read_amplification == 1.0
    q.fallback_to_recon_on_cold = True
    assert {r.semantic_distance for r in c.recall(q).collect()} == {0.0} and c.trace(q).first().read_amplification == 0.0
    c.close()
    assert cold.bytes_of(2, 3, encoding) == {"raw": 24, "f16": 12, "sq8": 14}[encoding]


def test_memory_budget(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c", raw_dram_budget=20)
    c.insert_many([record(i) for i in range(3)])
    c.flush()
    assert c.space.resident_raw_dram_bytes() == 0
    c.insert(record(9))
    assert c.space.resident_raw_dram_bytes() == 12 and len(ids(c.recall(RecallQuery()))) == 4
    c.close()


def test_log_damage(spark, tmp_path):
    log = oplog.OpLog(spark, f"file://{tmp_path}/log")
    rows = frame(spark, [row(1), row(2)])
    log.append(oplog.inserts(rows, 0), 0)
    at = log.next()
    log.append(oplog.deletes(spark, [1, 5], at), at)
    assert log.next() == at + 2 and log.read(at).count() == 2
    live, gone = oplog.replay(log.read())
    assert ids(live) == [2] and sorted(ids(gone)) == [1, 5]
    with pytest.raises(Exception):
        log.append(oplog.deletes(spark, [9], at), at)
    path = tmp_path / f"log/commits/{at:020d}.json"
    good = path.read_bytes()
    for damage in (good[:5], good.replace(b'"n": 2', b'"n": 3')):
        path.write_bytes(damage)
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError):
            log.read()
    assert log.repair() == 1 and log.next() == at and log.read().count() == 2
    changed = log.read().withColumn("record_id", F.lit(8).cast("long"))
    changed.coalesce(1).write.parquet(f"file://{tmp_path}/log/data/x")
    path.write_text(json.dumps({"first": at, "next": at + 2, "n": 2, "data": f"file://{tmp_path}/log/data/x"}))
    with pytest.raises(ValueError, match="checksum"):
        log.read()


def test_manifest(spark, tmp_path):
    files, at = Files(spark), f"file://{tmp_path}/m.json"
    m = Manifest(hashing.branch_id("b"), 5, [SegmentRef(1, "a\\b"), SegmentRef(2, "c")])
    assert m.write(files, at) == Manifest.read(files, at).manifest_id == hashing.manifest_id(1, 5, hashing.branch_id("b"), [(1, "a/b"), (2, "c")])
    m.write(files, at)
    for bad in (Manifest(segments=[SegmentRef(1, "a"), SegmentRef(1, "b")]), Manifest(segments=[SegmentRef(1, "")])):
        with pytest.raises(ValueError):
            bad.write(files, at)
    files.publish(at, files.read(at).replace(b'"path": "c"', b'"path": "d"'))
    with pytest.raises(ValueError, match="id"):
        Manifest.read(files, at)
    seg = SegmentRef(1, "a", n=3, dim=4, fingerprint="f")
    assert sidecar_problem(Sidecar(1, "pq", count=3, dim=4), seg) is None
    assert sidecar_problem(Sidecar(1, "pq", count=2), seg).startswith("count") and sidecar_problem(Sidecar(2, "pq"), seg).startswith("segment_id")
    assert hashing.fnv1a(b"") == hashing.BASIS and hashing.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_segment_checks(spark, tmp_path):
    rows = checked(frame(spark, [row(1), row(2)]))
    ref = segments.write(rows, f"file://{tmp_path}/s", 4)
    assert segments.read(spark, [ref], verify=True).count() == 2
    ref.n = 3
    with pytest.raises(ValueError, match="segment 4"):
        segments.read(spark, [ref], verify=True)
    bad = frame(spark, [row(1, symbols=["B"]), row(2, vec=(1, 2)), row(3)])
    assert {(r.rule, r.rows) for r in segments.violations(bad).collect()} == {("symbols", 1), ("dimension", 1)}
    assert segments.violations(segments.read(spark, [ref])).count() == 0


def test_files(spark, tmp_path):
    prepare(spark)
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    vectors.write_matrix(spark, f"file://{tmp_path}/v.bin", m)
    assert [r.embedding for r in vectors.read_matrix(spark, f"file://{tmp_path}/v.bin").orderBy("vec_id").collect()] == m.tolist()
    (tmp_path / "a.fvecs").write_bytes(b"".join(b"\x03\0\0\0" + r.tobytes() for r in m))
    (tmp_path / "a.ivecs").write_bytes(b"".join(b"\x03\0\0\0" + r.astype("<i4").tobytes() for r in m))
    for name in ("a.fvecs", "a.ivecs"):
        assert [list(r.embedding) for r in vectors.read_vecs(spark, f"file://{tmp_path}/{name}").orderBy("vec_id").collect()] == m.tolist()
    (tmp_path / "bad.bin").write_bytes(b"HNTQ" + bytes(12))
    with pytest.raises(Exception, match="not a file"):
        vectors.read_matrix(spark, f"file://{tmp_path}/bad.bin").collect()
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({**record(i), "segment_id": i % 2}) for i in range(3)) + "\n\n")
    assert sorted((r.segment_id, r.record_id) for r in vectors.read_jsonl(spark, f"file://{tmp_path}/r.jsonl").collect()) == [(0, 0), (0, 2), (1, 1)]
    (tmp_path / "q.json").write_text('{"symbols": ["a"], "limit": 3}')
    assert vectors.read_query(spark, f"file://{tmp_path}/q.json") == RecallQuery(symbols=["a"], limit=3)


# -- numbers


def test_quantization():
    q = quantize.Quantizer(0.5)
    assert q.quantize([0.25, 0.75, -0.25]).tolist() == [0, 2, 0] and q.dequantize([2]).tolist() == [1.0]
    for bad in (0.0, float("nan"), -1.0):
        with pytest.raises(ValueError):
            quantize.Quantizer(bad)
    x = np.random.default_rng(0).normal(size=(50, 7))
    for bits in (1, 2, 8):
        codes, _ = quantize.residual_np(x, bits)
        assert set(np.unique(codes)) <= {1: {-1, 1}, 2: {-3, -1, 1, 3}}.get(bits, set(range(-128, 128)))
        if bits < 8:
            assert (quantize.unpack_bits(quantize.pack_bits(codes[0], bits), 7, bits) == codes[0]).all()
    n = np.array([1, 15, 7])
    assert (quantize.unpack_nibbles(quantize.pack_nibbles(n), 3) == n).all()
    tiny = np.array([2.0**-15, 2.0**-24, 1.5, -65504.0], np.float32)
    assert (quantize.f16_vector(quantize.f16_bytes(tiny)) == tiny).all()


def test_orders():
    keys = zorder.zorder(np.array([[0, 0], [0, 1], [1, 0], [-1, 0]]))
    assert keys[3] < keys[0] < keys[1] < keys[2] and len(keys[0]) == 4
    assert len(zorder.morton(np.array([[1, 2, 3]]))[0]) == 16
    cells = sorted((zorder.hilbert([a, b], 3), (a, b)) for a in range(8) for b in range(8))
    assert [d for d, _ in cells] == list(range(64))
    assert all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for (_, p), (_, q) in zip(cells, cells[1:]))


def cloud(n=500, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=4, size=(10, dim))
    return centres[rng.integers(10, size=n)] + rng.normal(size=(n, dim))


def table(spark, x, name="vec_id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, embedding array<float>")


def test_nearest_is_exact(spark):
    prepare(spark)
    x = np.float32(np.vstack([cloud(300), np.tile(cloud(1), (60, 1))])).astype(float)
    found = knn.nearest(table(spark, x), table(spark, x[::37], "query_id"), 5).orderBy("query_id", "rank").collect()
    for i, q in enumerate(x[::37]):
        assert [r.vec_id for r in found if r.query_id == i] == blocks.exact_topk(x, q, 5).tolist()


def coverage(route, x, k=10):
    queries = x[::25] + 0.1
    return blocks.coverage([route(q)[:k] for q in queries], [blocks.exact_topk(x, q, k) for q in queries])


def test_routers_cover():
    x = cloud()
    assert coverage(lambda q: pivot.PivotPrefix(x, pivot.PivotConfig(32, 16, 4, 6, 200)).route(q)[0], x) > 0.9
    assert coverage(lambda q: pivot.DenseSketch(x, pivot.PivotConfig(32, 16, 4, 6, 200)).route(q)[0], x) > 0.9
    sketch = pivot.DenseSketch(x, pivot.PivotConfig(32, 16, 4, 6, 200))
    assert all(coverage(lambda q: sketch.route(q, sketch.stored(kind))[0], x) > 0.9 for kind in ("fp16", "u16"))
    tree = tangent.TangentTree(x, tangent.TangentConfig(beam=8, final_nprobe=32))
    assert coverage(lambda q: tree.route(q)[0], x) > 0.4 and tree.resident_bytes() > x.size * 4
    d = tree.diagnostics()
    assert 1 <= d["d80"] <= d["d90"] <= d["d95"] <= 8 and 0 < d["radius_shrink"] < 1 and d["separation_p10"] <= d["separation_p25"]
    hlr = lattice.HierarchicalLattice(x)
    assert hlr.residual_energy == sorted(hlr.residual_energy, reverse=True) and coverage(lambda q: hlr.route(q, 40), x) > 0.5
    flat = lattice.Lattice(x, 6, 0.1)
    assert coverage(lambda q: flat.route(q, 40), x) > 0.6
    assert lattice.refined(flat, x, x[3], 5)[0] == 3 and sorted(lattice.refined(flat, x, x[3], 5)) == list(range(500))
    assert (tree.route(x[5])[0] == tangent.TangentTree(x, tree.config).route(x[5])[0]).all()


def test_research_routers_cover():
    x = cloud()
    made = [graphs.PointGraph(x), graphs.BlockGraph(x), graphs.BlockGraph(x, rule="rng"), more.Landmarks(x, 32, 2, 40), more.SpillTree(x), more.SpillTree(x, dims=4)]
    assert all(coverage(lambda q: m.route(q, 10), x) > 0.9 for m in made)
    for kind in ("trie", "morton", "gray", "hilbert"):
        assert coverage(lambda q, c=more.CurveOrder(x, kind): c.route(q, 10), x) > 0.3
    assert coverage(lambda q: more.chunked_rerank(x, np.arange(500), q, 10, 4), x) > 0.8
    assert all(len(e) <= 4 for e in graphs.neighbours(x, 4, "knn"))


def test_pivot_tables_route_like_the_model(spark):
    x = np.float32(cloud()).astype(float)
    model = pivot.PivotPrefix(x, pivot.PivotConfig(32, 16, 3, 4, 200))
    pivots, posts, payload = model.tables(spark)
    q = spark.createDataFrame([(i, [float(v) for v in x[i * 50]]) for i in range(10)], "query_id long, embedding array<double>")
    chosen = pivot.route_blocks(q, pivots, posts, 3, 4, "weighted", 8)
    rows = pivot.scan_blocks(q, chosen, payload, 200, 8).orderBy("query_id", "rank").collect()
    for i in range(10):
        assert [r.vec_id for r in rows if r.query_id == i] == model.route(x[i * 50])[0].tolist()


def test_clusterings():
    x = cloud()
    own = kmeans.balanced(x, 8)
    assert np.bincount(own).max() <= np.ceil(1.3 * 500 / 8) and len(np.unique(own)) == 8
    two = kmeans.two_means(np.array([[0.0], [0.1], [9.0], [9.1]]))
    assert two[0] == two[1] != two[2] == two[3]
    parts, means = blocks.balanced_blocks(x, 64, 2)
    assert sorted(np.concatenate(parts)) == list(range(500)) and max(map(len, parts)) <= 64 and list(means[:, 0]) == sorted(means[:, 0])
    with pytest.raises(ValueError):
        blocks.guard(np.zeros((0, 3)))


def test_grain_codes():
    x = cloud()
    g = grain.train(x, 8, 4, 8)
    coords, residual, sketch = g.encode(x)
    assert np.abs(g.decode(coords, sketch) - x).max() < 0.05
    order = np.argsort(g.scores(x[7], coords, residual, sketch)[0])
    assert order[0] == 7
    assert grain.adaptive_shape(x * np.array([1] + [0.001] * 7), 0.9, (1, 4), (0, 4), 2, 8)[0] == 1
    shared, grains = shared_pq.train(x, np.zeros(500, int), 4, 4, 4, True)
    one = grains[0]
    c = one.coords(shared, x)
    back = shared_pq.reconstruct(shared, one, c, shared.codes(x - one.base(shared, c)))
    assert ((back - x) ** 2).mean() < 0.5 * ((one.base(shared, c) - x) ** 2).mean()


def test_index(spark, tmp_path):
    x = np.float32(cloud()).astype(float)
    queries = table(spark, x[::50], "query_id")
    truth = knn.nearest(table(spark, x), queries, 10)
    share = lambda df: knn.recall_at(df, truth, 10).agg(F.avg("recall")).first()[0]
    index = GrainIndex(spark, 8, Options(8, 4, rerank_factor=8)).build(table(spark, x), 6)
    assert share(index.search_mode_a(queries, 10)) == 1.0 and share(index.search_mode_b(queries, 10, 60, 6)) > 0.9
    assert share(index.search_mode_a(queries, 10, 3)) > 0.7
    with pytest.warns(DeprecationWarning):
        assert index.search(queries, 3).count() == 30
    near = index.scan_below(queries, 1.0).select("query_id", "vec_id").collect()
    assert {(i, 50 * i) for i in range(10)} <= {(r.query_id, r.vec_id) for r in near}
    index.save(f"file://{tmp_path}/i")
    again = GrainIndex.load(spark, f"file://{tmp_path}/i")
    assert again.raw is None and share(again.search_mode_a(queries, 10)) > 0.9 and again.encoded_bytes() == index.encoded_bytes() > 0
    again.options.rerank_factor = 0
    assert again.search_mode_a(queries, 10).count() == 100
    assert index.stats().agg(F.sum("rows")).first()[0] == 500
    index.insert(table(spark, x[:1] + 100).withColumn("vec_id", F.lit(9999).cast("long")))
    assert index.search_mode_a(table(spark, x[:1] + 100, "query_id"), 1).first().vec_id == 9999
    for more_options in ({"shared_parts": 4, "shared_bits": 4}, {"residual_bits": 2}, {"adaptive": 0.8}):
        other = GrainIndex(spark, 8, Options(8, 4, rerank_factor=8, **more_options)).build(table(spark, x), 4)
        assert share(other.search_mode_b(queries, 10, 100)) > 0.9
        other.save(f"file://{tmp_path}/{len(other.centroids)}-{next(iter(more_options))}")
        kept = GrainIndex.load(spark, f"file://{tmp_path}/{len(other.centroids)}-{next(iter(more_options))}")
        assert kept.encoded_bytes() == other.encoded_bytes() and share(kept.search_mode_b(queries, 10, 100)) > 0.3
    index = GrainIndex(spark, 8, Options(8, 4, rerank_factor=8)).build(table(spark, x), 12)
    index.router = lattice.HierarchicalLattice(index.centroids)
    assert share(index.search_mode_a(queries, 10, 8)) > 0.7
    index.save(f"file://{tmp_path}/j")
    again = GrainIndex.load(spark, f"file://{tmp_path}/j")
    again.attach_raw_vectors(table(spark, x))
    assert again.search_mode_a(queries, 10, 8).collect() == index.search_mode_a(queries, 10, 8).collect()
    split = GrainIndex(spark, 8, Options(8, 4, block_size=16, split_at=100)).build(table(spark, x), 2)
    assert split.split_large() == 2 and len(split.centroids) == 4 and split.codes.count() == 500


def test_write_buffer(spark):
    x = np.float32(cloud()).astype(float)
    rows = table(spark, x)
    buffer = WriteBuffer(GrainIndex(spark, 8, Options(8, 4, rerank_factor=8)).build(rows.where("vec_id < 400"), 4), 4)
    buffer.insert(rows.where("vec_id >= 390"))  # ten ids in both
    queries = table(spark, x[::50], "query_id")
    want = [tuple(r)[:3] for r in knn.nearest(rows, queries, 10).orderBy("query_id", "rank").collect()]
    assert [tuple(r)[:3] for r in buffer.search(queries, 10).orderBy("query_id", "rank").collect()] == want
    buffer.compact()
    assert buffer.rows is None and buffer.search(queries, 10).count() == 100


def test_statistics(spark):
    x = np.float32(cloud(200, 4)).astype(float)
    got = {r.dim: r for r in stats.axis_stats(table(spark, x)).collect()}
    assert all(got[i].variance == pytest.approx(x[:, i].var(), rel=1e-6) and got[i].mean == pytest.approx(x[:, i].mean(), rel=1e-6) for i in range(4))
    v = np.sort(x.var(axis=0))[::-1]
    assert stats.effective_dims(stats.axis_stats(table(spark, x)), 0.7).first().dims == int(np.searchsorted(np.cumsum(v), 0.7 * v.sum()) + 1)
    basis, values = stats.pca(x, 4)
    assert np.allclose(basis @ basis.T, np.eye(4)) and list(values) == sorted(values, reverse=True)


# -- the rest


def test_text_tools(spark):
    docs = spark.createDataFrame([(1, "Storage engine writes segments"), (2, "storage engine reads segments and the cache"), (3, "unrelated words here")], "doc_id long, text string")
    w = text.tfidf(docs)
    norms = {r.doc_id: r.n for r in w.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()}
    assert all(n == pytest.approx(1.0) for n in norms.values()) and w.where("term = 'the'").count() == 0
    v = {r.doc_id: np.array(r.embedding) for r in text.project(w, 64).collect()}
    assert v[1] @ v[2] > v[1] @ v[3] and np.linalg.norm(v[1]) == pytest.approx(1.0, abs=1e-5)
    steps = spark.createDataFrame([("a/b/Main.rs", "edit", "tool"), ("", "chat", None)], "path string, kind string, source string")
    assert [r.symbols for r in text.step_symbols(steps).collect()] == [["Main.rs", "rs", "edit", "tool"], ["chat"]]


def test_command_line(spark, tmp_path):
    from recallforge.cli import main

    x = np.float32(cloud(200))
    at = f"file://{tmp_path}"
    vectors.write_matrix(spark, f"{at}/v.bin", x)
    vectors.write_matrix(spark, f"{at}/q.bin", x[:4], "queries")
    run = lambda *a: (out := io.StringIO(), main(list(a), spark, out))[0].getvalue()
    assert "200 vectors in 4 grains" in run("build", "--vectors", f"{at}/v.bin", "--output", f"{at}/i", "--grains", "4", "--local-dim", "8", "--sketch-dim", "4", "--enable-lattice-routing", "--spacing", "0.1")
    lines = run("query", "--index", f"{at}/i", "--queries", f"{at}/q.bin", "--top-k", "2").splitlines()
    assert lines[0] == "query_id,rank,vector_id,distance" and [x.split(",")[2] for x in lines[1::2]] == ["0", "1", "2", "3"]
    assert run("eval", "--index", f"{at}/i", "--vectors", f"{at}/v.bin", "--queries", f"{at}/q.bin", "--raw-rerank").strip() == "recall@10 = 1.0000"
    with pytest.raises(SystemExit):
        main(["query", "--wrong", "1"], spark)
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(record(i)) for i in range(3)))
    (tmp_path / "q.json").write_text('{"limit": 2}')
    assert "3 records" in run("remember", "--root", f"{at}/space", "--records", f"{at}/r.jsonl")
    assert [json.loads(x)["record_id"] for x in run("recall", "--root", f"{at}/space", "--query", f"{at}/q.json").splitlines()] == [0, 1]
    assert "forked" in run("fork", "--root", f"{at}/space", "--name", "b", "--manifest", f"{at}/space/b.json")


def test_session_windows_and_stream(spark, tmp_path):
    from recallforge.streaming import streams

    rows = [(i, ["a", "error"][i == 3], i % 2, float(i)) for i in range(6)]
    e = spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 100))
    assert streams.sessions(e, "150 seconds").count() == 6 and streams.sessions(e, "5 minutes").count() == 2
    sink = streams.LatestSink(f"file://{tmp_path}/out")
    sink(spark.createDataFrame([(0, "insert", 1), (1, "insert", 2)], "seq long, op string, record_id long"), 0)
    sink(spark.createDataFrame([(2, "delete", 1)], "seq long, op string, record_id long"), 1)
    sink(spark.createDataFrame([(2, "delete", 1)], "seq long, op string, record_id long"), 1)  # run again after a failure
    assert sorted((r.record_id, r.op) for r in sink.read(spark).collect()) == [(1, "delete"), (2, "insert")]


def test_stray_candidates_are_refused(spark):
    from recallforge.operators.candidates import CandidateGenerator

    class Stray(CandidateGenerator):
        def __init__(self, rows):
            self.rows = rows

        def candidates(self, records, query):
            return records.sparkSession.createDataFrame(self.rows, "segment_id long, local_id int")

    rows = frame(spark, [row(1), row(2, scope=8), row(3)])
    assert ids(recall.recall(rows, RecallQuery(scope_id=7), Stray([(1, 1), (1, 1)]))) == [1]
    with pytest.raises(Exception, match="filters dropped"):
        recall.recall(rows, RecallQuery(scope_id=7), Stray([(1, 1), (1, 2)])).collect()


def test_a_dead_writers_lock_is_taken_over(spark, tmp_path):
    import socket

    at = f"file://{tmp_path}/c"
    c = Collection(spark, at)
    lock = c.space._lock
    with pytest.raises(RuntimeError):
        Collection(spark, at)
    files = c.space.files
    files.delete(lock)
    files.create(lock, json.dumps({"host": socket.gethostname(), "pid": 2**22 + 12345, "id": "x"}).encode())
    again = Collection(spark, at)
    assert again.space.notes == ["took over the lock of a writer that is gone"]
    again.close()
    files.create(lock, json.dumps({"host": "another", "pid": 1, "id": "x"}).encode())
    with pytest.raises(RuntimeError):
        Collection(spark, at)
    Collection(spark, at, take_over=True).close()


def test_large_segments_are_planned_without_a_router(spark):
    rows = spark.range(40).selectExpr("1L AS segment_id", "cast(id AS int) AS local_id", "array(cast(id AS float), 0f) AS embedding")
    query = RecallQuery(embedding=[3.0, 0.0], candidate_budget=4)
    config = planner.PlannerConfig(tangent_min_rows=10, pivot_min_rows=10, direct_at_most=5, route_at_most=30)
    found = planner.Planner(config).traced(rows, query).collect()
    assert {r.selected_path for r in found} == {"array_like"} and len(found) == 4


def test_morton_interleaves_the_first_coordinate_highest():
    key = int.from_bytes(zorder.morton(np.array([[-32768 + 1, -32768]]))[0], "big")
    assert key == 2 and int.from_bytes(zorder.morton(np.array([[-32768, -32767]]))[0], "big") == 1


def test_residual_levels_round_before_they_compare():
    codes = quantize.residual_levels_np(np.array([[-0.4, -2.4, 1.6, 2.5, -2.6]]), np.ones(5), 2)
    assert codes.tolist() == [[1, -1, 3, 3, -3]]


def test_manifest_ids_tell_a_parent_from_none():
    assert hashing.manifest_id(1, None, 5, []) == hashing.fnv1a((1).to_bytes(4, "little") + b"\0" + bytes(8) + (5).to_bytes(8, "little") + bytes(8))
    assert hashing.manifest_id(1, 3, 5, []) == hashing.fnv1a((1).to_bytes(4, "little") + b"\1" + (3).to_bytes(8, "little") + (5).to_bytes(8, "little") + bytes(8))
