from collections import Counter

import pyarrow as pa
import pytest

from recallforge.llm import bpe, mixing, queries, toxicity
from . import test_exact_dedup, test_near_dedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_run_equals_the_stages_by_brute_force(spark, data):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    table = spark.read.parquet(f"{data}/documents.parquet")
    model = queries.toxicity_model(table, spark.read.parquet(f"{data}/labels.parquet"))
    scores = model.judged(pa.array([r.text for r in docs.values()], pa.string()))[0]
    clean = [d for d, score in zip(docs, scores) if score < toxicity.THRESHOLD]
    single = [d for d, _, _, kept, _ in test_exact_dedup.brute([(d, docs[d].text) for d in clean]) if kept]
    apart = test_near_dedup.brute([(d, docs[d].text) for d in single])
    left = spark.createDataFrame([docs[d] for d in apart], table.schema)
    copies = {r.doc_id: r.copies for r in mixing.assign(left).collect() if r.copies}
    got = corpus_pipeline.run(spark, data).collect()
    assert Counter(r.doc_id for r in got) == Counter(copies)
    own = bpe.load(queries.tokenizer_path())
    for r in got:
        n, joined, _ = own.encode_batch([docs[r.doc_id].text])[0]
        assert (r.n_tokens, ",".join(map(str, r.ids)), r.source) == (n, joined, docs[r.doc_id].source)


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns, name
        assert stage(spark, docs.limit(0), data).count() == 0, name


def test_stages_take_odd_rows(spark, data):
    from . import odd

    docs = odd.frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert 0 < stage(spark, docs, data).count() <= 2 * len(odd.ROWS), name
