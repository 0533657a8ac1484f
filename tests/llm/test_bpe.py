import hashlib
import random

import pytest

from recallforge.llm import bpe, queries
from . import odd

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(library, rows):
    out = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark, data, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert got(queries.op8_bpe(spark, data)) == want(library, rows)


def test_odd_rows(spark, library, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *a: odd.frame(spark))
    assert got(queries.op8_bpe(spark, "")) == want(library, [r[:2] for r in odd.ROWS])
    monkeypatch.setattr(queries, "table", lambda *a: odd.frame(spark, []))
    assert got(queries.op8_bpe(spark, "")) == []


def test_random_texts(library):
    rng, own = random.Random(1), bpe.load(queries.tokenizer_path())
    alphabet = "abcdeé  \n\t'sthe0123!?.ñ漢字🙂#<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(300)) for _ in range(50)]
    texts += ["a" * 3000, "#" * 100, "ab" * 500, "the" * 300, " " * 50, "<|endoftext|><|endoftext|>x"]
    for text, (n, joined, raw) in zip(texts, own.encode_batch(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (n, joined) == (len(ids), ",".join(map(str, ids)))
        assert raw.decode() == library.decode(ids, skip_special_tokens=False) == text


def test_a_full_cache_changes_nothing(monkeypatch):
    own = bpe.ByteBPE(queries.tokenizer_path())
    texts = [f"word{i} and other{i * 7}" for i in range(300)]
    first = own.encode_batch(texts)
    monkeypatch.setattr(bpe, "CACHED", 10)
    assert [x for t in texts for x in own.encode_batch([t])] == first


def test_encode_and_decode_are_inverse(spark):
    docs = odd.frame(spark)
    encoded = bpe.encode(docs, queries.tokenizer_path(), "lang")
    assert encoded.columns == ["doc_id", "lang", "n_tokens", "ids"]
    decoded = bpe.decode(encoded, queries.tokenizer_path()).collect()
    assert sorted((str(r.doc_id), r.text) for r in decoded) == sorted((str(r[0]), r[1] or "") for r in odd.ROWS)
    assert all(r.n_tokens == len(r.ids) for r in encoded.collect())
