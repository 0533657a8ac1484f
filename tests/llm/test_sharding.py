import hashlib
from collections import defaultdict

from recallforge.llm import queries, sharding
from . import odd


def bits(doc_id):
    return f"{int(hashlib.md5(('' if doc_id is None else str(doc_id)).encode()).hexdigest()[:9], 16):036b}"


def check(rows, texts, limit):
    size, docs = defaultdict(int), defaultdict(int)
    for r in rows:
        assert len(r.shard) == r.depth and (r.depth > 36 or bits(r.doc_id).startswith(r.shard))
        size[r.shard] += r.bytes
        docs[r.shard] += 1
    for r in rows:
        assert (r.shard_bytes, r.shard_docs) == (size[r.shard], docs[r.shard])
    assert len(rows) == len(texts) and sum(size.values()) == sum(len((t or "").encode()) for t in texts)
    for s in size:  # within the limit, no shard inside another, and the bucket it came from was too large
        assert size[s] <= limit
        assert not any(t != s and t.startswith(s) for t in size)
        assert not s or sum(n for t, n in size.items() if t.startswith(s[:-1])) > limit
    return size


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    size = check(sharding.assign(docs, 40_000, 3).collect(), [r.text for r in docs.collect()], 40_000)
    assert len(size) > 10


def test_one_shard_and_none(spark):
    df = odd.frame(spark)
    rows = sharding.assign(df, 1 << 30).collect()
    assert {r.shard for r in rows} == {""} and len(rows) == len(odd.ROWS)
    assert sharding.assign(odd.frame(spark, [])).count() == 0


def test_a_hot_key_is_split_as_well(spark):
    rows = [(1, "x" * 100)] * 400 + [(i, "y" * 100) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    size = check(sharding.assign(df, 5000).collect(), [t for _, t in rows], 5000)
    assert any(len(s) > 36 for s in size)


def test_write(spark, tmp_path):
    df = odd.frame(spark)
    path = sharding.write(df, f"file://{tmp_path}/out", limit=100_000)
    back = spark.read.parquet(path)
    assert back.count() == len(odd.ROWS) and back.select("shard_").distinct().count() > 1
    assert set(df.columns) < set(back.columns) and back.where("shard = 's'").count() == len(odd.ROWS)


def test_write_splits_a_hot_key_and_keeps_each_row_once(spark, tmp_path):
    rows = [(1, "x" * 100, i % 3) for i in range(400)] + [(None, "z" * 50, 7)] * 60 + [(i, "y" * 100, i) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more int").repartition(3)
    back = spark.read.parquet(sharding.write(df, f"file://{tmp_path}/out", limit=5000)).collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.more) for r in back))) == sorted(map(str, rows))
    size = defaultdict(int)
    for r in back:
        size[r.shard] += len(r.text)
    assert max(size.values()) <= 5000


def test_shards_dont_depend_on_the_layout(spark):
    rows = [(1, "x" * 100)] * 300 + [(1, f"{i}" * 30) for i in range(100)] + [(i, "y" * 100) for i in range(50)]
    found = []
    for n in (1, 5):
        df = spark.createDataFrame(rows[::-1] if n > 1 else rows, "doc_id long, text string").repartition(n)
        found.append(sorted((r.doc_id, r.shard, r.bytes, r.shard_docs) for r in sharding.assign(df, 5000).collect()))
    assert found[0] == found[1]


def test_empty_table_through_the_query(spark, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *a: odd.frame(spark, []))
    assert queries.op6_sharding(spark, "").count() == 0
