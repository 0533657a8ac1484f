import math
import zlib
from collections import Counter

import numpy as np
import pytest

from recallforge.llm import queries, toxicity
from . import odd

LOWER = {i: i + 32 for i in range(65, 91)}
BAD = ["blorp", "snarg", "quibdis"]


def corpus(n=600):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(400)}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            words[10:12] = [str(x) for x in rng.choice(BAD, 2)]
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 != 1], "doc_id long, toxic int")
    return rows, docs, toxicity.fit(docs, given)


def brute_terms(text):
    """{(stem, level)} of a text, by plain string handling."""
    cut = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").translate(LOWER)).split()
    counts = Counter(w.encode()[: toxicity.STEM] for w in cut)
    return {(s, i) for s, n in counts.items() for i in range(n.bit_length())}


def brute(texts, labelled, k=toxicity.NEIGHBOURS, examples=toxicity.EXAMPLES):
    """{doc_id: (score, [(cosine, doc_id)])} from definitions: dense vectors, all cosines, sorted lists.

    texts and labelled are dicts by doc_id; only usable without a class over its bound.
    """
    terms = {i: brute_terms(t) for i, t in texts.items()}
    own = sorted(i for i in labelled if i in texts)
    assert all(sum(labelled[i] == v for i in own) <= examples for v in (0, 1))
    df = Counter(s for t in terms.values() for s in {s for s, _ in t})
    known = sorted({t for i in own for t in terms[i]})
    distinct = {frozenset(terms[i]): i for i in own}.values()
    n = {v: max(1, sum(labelled[i] == v for i in distinct)) for v in (0, 1)}
    weight = {}
    for t in known:
        a, b = (sum(t in terms[i] for i in distinct if labelled[i] == v) for v in (1, 0))
        x = 0.0
        if a / n[1] > b / n[0]:
            p = (a + b) / (n[0] + n[1])
            part = lambda o, e: o * math.log(o / e) if o else 0.0
            x = 2 * (part(a, n[1] * p) + part(b, n[0] * p) + part(n[1] - a, n[1] * (1 - p)) + part(n[0] - b, n[0] * (1 - p)))
        weight[t] = math.log((len(texts) + 1) / (df[t[0]] + 0.5)) * (1 + math.log1p(max(0.0, x - toxicity.telling(len(known)))))
    other = math.log((len(texts) + 1) / (len(texts) / len(own) + 0.5))
    unit = {}
    for i, found in terms.items():
        length = math.sqrt(sum(weight.get(t, other) ** 2 for t in found)) or 1.0
        unit[i] = {t: weight[t] / length for t in found if t in weight}
    share = sum(labelled[i] for i in own) / len(own)

    def near(i, but=None):
        cos = [(sum(w * unit[j].get(t, 0.0) for t, w in unit[i].items()), j) for j in own if j != but]
        return [c for c in sorted(cos, key=lambda c: -c[0])[:k] if c[0] > 1e-12]

    def vote(found):
        w = [1 / (1 - min(c, 1.0) + toxicity.EPS) for c, _ in found]
        return (sum(x * labelled[j] for x, (_, j) in zip(w, found)) + toxicity.PRIOR * share) / (sum(w) + toxicity.PRIOR)

    steps = toxicity.isotonic(np.array([vote(near(i, i)) for i in own]), np.array([labelled[i] for i in own], float), np.ones(len(own)))
    return {i: (float(np.interp(vote(f), *steps)), f) for i in texts for f in [near(i)]}


def test_held_out_rows(fitted):
    rows, docs, model = fitted
    held = [(r.score, r.doc_id % 5 == 0) for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all((s >= toxicity.THRESHOLD) == bad for s, bad in held)
    assert all(0 <= s <= 1 for s, _ in held)


def test_every_example_and_every_text_takes_part(fitted):
    rows, docs, model = fitted
    given = [i for i, _ in corpus()[1] if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(model.ids.tolist()) == given and model.index.n == len(given)
    assert all(r.near for r in toxicity.score(docs, model).collect())


def test_nearest_is_exact(fitted, monkeypatch):
    rows, _, _ = fitted
    rng = np.random.default_rng(1)
    n, t = 700, 300
    dense = np.where(rng.random((n, t)) < rng.random(t) ** 4, rng.random((n, t)), 0.0)
    dense[5] = dense[600] = dense[350]  # ties
    at, columns = np.nonzero(dense)
    for block, full in ((16, 10_000), (64, 12), (128, 1)):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        monkeypatch.setattr(toxicity, "DENSE", full)
        index = toxicity.Index(n, t, columns, at, dense[at, columns])
        queries_ = [(np.flatnonzero(q), q[q > 0]) for q in dense[:80]] + [(np.zeros(0, np.int64), np.zeros(0))]
        for i, (got, values) in enumerate(index.nearest(queries_, 9, [i if i % 2 else -1 for i in range(81)])):
            cos = dense @ dense[i] if i < 80 else np.zeros(n)
            if i % 2:
                cos[i] = 0
            want = sorted((j for j in range(n) if cos[j] > 0), key=lambda j: (-round(cos[j], 9), j))[:9]
            assert got.tolist() == want and np.allclose(values, cos[want])


def test_isotonic_pools_ties():
    xs, ys = toxicity.isotonic(np.array([0.1] * 7 + [0.3] * 4 + [0.9] * 9), np.array([0] * 7 + [1, 0, 1, 0] + [1] * 9), np.ones(20))
    assert np.all(np.diff(xs) > 0) and np.all(np.diff(ys) >= 0)
    assert np.interp(0.3, xs, ys) == 0.5
    xs, ys = toxicity.isotonic(np.linspace(0, 1, 31), np.zeros(31), np.ones(31))
    assert len(set(ys)) == 1 and np.all(np.diff(xs) > 0)
    xs, ys = toxicity.isotonic(np.array([0.2, 0.2]), np.array([0.0, 1.0]), np.array([3.0, 1.0]))
    assert xs.tolist() == [0.2] and ys.tolist() == [(0.25 * 2 + 0.5) / 3]


def test_sampled_classes_keep_their_rates(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{rng.integers(50)}" for _ in range(30)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    whole, cut = toxicity.fit(docs, labels), toxicity.fit(docs, labels, 40)
    assert whole.index.n == 400 and cut.index.n == 80
    assert whole.share == pytest.approx(0.1) == cut.share
    mean = lambda m: np.mean([r.score for r in toxicity.score(docs, m).collect()])
    assert mean(cut) < 0.25 and abs(mean(whole) - mean(cut)) < 0.15


def test_labels_matter_only_where_given(spark, fitted):
    rows, docs, model = fitted
    other = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").selectExpr("doc_id", "text", "'x' lang", "'y' source", "1 toxic")
    a = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.score(other, model).collect()}


def test_odd_rows(spark, fitted):
    model = fitted[2]
    got = toxicity.score(odd.frame(spark), model).collect()
    prior = float(np.interp(model.share, *model.steps))
    assert len(got) == len(odd.ROWS) and all(r.score == pytest.approx(prior) for r in got if r.doc_id in (2, 3, 4))
    assert toxicity.score(odd.frame(spark, []), model).count() == 0
    kept = toxicity.keep_clean(odd.frame(spark), model)
    assert kept.columns == odd.frame(spark).columns and kept.count() == len(odd.ROWS)


def test_without_labels(spark):
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    docs = odd.frame(spark)
    assert toxicity.fit(docs, none) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.fit(docs, spark.createDataFrame([(1, 0), (5, 1)], "doc_id long, toxic int")) is not None
    assert toxicity.fit(odd.frame(spark, []), none) is None


def test_query_equals_brute_force(spark, data):
    rows = queries.op4_toxicity(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labelled = {}
    for r in spark.read.parquet(f"{data}/labels.parquet").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            labelled[r.doc_id] = max(r.toxic, labelled.get(r.doc_id, 0))
    want = brute(texts, labelled)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        score, near = want[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
        assert r.score == pytest.approx(score, abs=1e-6)
        assert r.cosines == pytest.approx([c for c, _ in near], abs=1e-9)
