r"""Toxicity from nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are the stems of all words of the whole text: a word is a run of letters and digits (ASCII) and other
characters beyond ASCII, A-Z in lower case, its stem the first STEM bytes of its UTF-8. Term frequency is spelled out as
levels: a stem that occurs n times has the terms of levels 1, 2, 4, ... up to n, so its weight grows with the
logarithm of n and a text that repeats a word differs from one that has it once. A term weighs idf * relevance:
idf is the stem's, counted over all documents; relevance is 1 + ln(1 + x), x the part of the term's
log-likelihood ratio (toxic against clean examples, copies of one text counted once) that chance doesn't
explain, so it is 1 for nearly all terms. No term of a text or an example is left out: one that no example has counts in the
text's length, with the idf of a stem that one of as many documents as there are examples has. Texts and
examples are unit vectors of these weights.

The index cuts the examples into blocks; each posting list has its largest weight per block. Terms that
more than one of DENSE examples have are kept as full columns, as their lists would hold most blocks
anyway; what they add is computed for all examples at once and enters the blocks' bounds. A text's blocks
are visited in two runs, those with the highest bounds and then all whose bound can still enter the best
k, so the k nearest are exact. Neighbours vote with weight 1 / (1 - cosine + EPS),
times the rate at which their class was sampled, with a vote of PRIOR strength for the share of toxic
labels. A monotone function, fitted to the votes that each example gets from the others, turns votes into
calibrated scores; examples count in it by the same rates, so a score means the same at every size.

Bounds: `examples` labelled rows a class at most, taken by a hash of doc_id (the only sampling here); the
model that is sent to the workers has their vectors and nothing else. All texts are read whole, counted
and scored, one by one.

Defined cases: null and blank texts have no neighbours and get the calibrated score of the prior alone;
labels with null toxic or null doc_id aren't used, of repeated labels the larger one counts; of rows that
repeat a labelled doc_id the one with the largest text is the example; documents without labels of both
classes all score 0.0; ties of cosine go to the example that stands first in the index; rows are scored one by
one, repeated ones alike; very long texts are read whole, one at a time; extra columns aren't read; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._common import materialise, prepare, slices

#: Labelled examples of each class at most.
EXAMPLES = 1500
#: Bytes of a word that count.
STEM = 6
#: So many of all terms of the examples would be telling by chance alone, without any meaning.
BY_CHANCE = 1.0
NEIGHBOURS, BLOCK, EPS, PRIOR = 25, 128, 0.05, 0.5
#: A term of more than one in DENSE examples is a full column. Blocks of the first run.
DENSE, FIRST = 24, 2
#: Texts that are judged at once.
TOGETHER = 64
THRESHOLD = 0.7

#: Bits of a term's number that hold its level.
LEVELS = 63
_SEED = 42
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def stem_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(XXH64 of all distinct stems, and of each text and stem in it: place of the text, of the stem, how often)."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    plain = b"" if data is None else data[int(at[0]) : int(at[-1])].to_pybytes().translate(_TABLE)
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(plain)])
    words = pc.ascii_split_whitespace(plain)
    coded = pc.binary_slice(words.flatten().cast(pa.large_binary()), 0, STEM).dictionary_encode()
    stems = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, _SEED) for w in stems), np.uint64, len(stems)).view(np.int64) & ~LEVELS
    place = coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
    real = np.array([w != b"" for w in stems], bool)[place]
    both, counts = np.unique(text[real] * max(1, len(stems)) + place[real], return_counts=True)
    return hashes, both // max(1, len(stems)), both % max(1, len(stems)), counts


def reached(counts: np.ndarray) -> np.ndarray:
    """How many levels a stem of so many occurrences has; level i is reached at 2 ** i of them."""
    return np.frexp(counts)[1].astype(np.int64)


def terms_of(texts: pa.Array) -> pa.ListArray:
    """The terms of each text as numbers in rising order: a stem's hash, with the level in its lowest bits."""
    hashes, text, place, counts = stem_counts(texts)
    n = reached(counts)
    level, _ = _ranges(np.zeros(len(n), np.int64), n)
    terms, text = np.repeat(hashes[place], n) | level, np.repeat(text, n)
    order = np.lexsort((terms, text))
    ends = np.searchsorted(text[order], np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms[order], pa.int64()))


def _log_ratio(a: np.ndarray, b: np.ndarray, na: float, nb: float) -> np.ndarray:
    """Log-likelihood ratio of a of na against b of nb; 0 where a isn't the more frequent."""
    def part(x, n, p):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(n * p, 1e-12)), 0.0)

    p = (a + b) / (na + nb)
    g = 2 * (part(a, na, p) + part(b, nb, p) + part(na - a, na, 1 - p) + part(nb - b, nb, 1 - p))
    return np.where(a / na > b / nb, g, 0.0)


def telling(candidates: int) -> float:
    """The log-likelihood ratio (chi-squared, one degree of freedom) that chance explains."""
    return NormalDist().inv_cdf(1 - min(0.5, BY_CHANCE / max(1, candidates)) / 2) ** 2


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of the ranges start..end one after the other, length of each)."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n), n


class Index:
    """Unit vectors of the examples as posting lists by term, cut into blocks with the largest weight of each.

    columns, rows and weights say which term (a column number) weighs how much in which example.
    """

    def __init__(self, n: int, n_columns: int, columns: np.ndarray, rows: np.ndarray, weights: np.ndarray):
        self.n, self.n_blocks = n, n // BLOCK + 1
        frequent = np.flatnonzero(np.bincount(columns, minlength=n_columns) * DENSE > n)
        self.dense_of = np.full(n_columns, -1)
        self.dense_of[frequent] = np.arange(len(frequent))
        full = self.dense_of[columns] >= 0
        self.full, self.dense = (self.dense_of[columns[full]], rows[full], weights[full]), None

        columns, rows, weights = columns[~full], rows[~full].astype(np.int32), weights[~full]
        order = np.lexsort((rows, columns))
        columns, self.rows, self.weights = columns[order], rows[order], weights[order]
        runs = np.flatnonzero(np.diff(columns * self.n_blocks + self.rows // BLOCK, prepend=-1))  # a term's entries in a block
        self.run_block, self.run_start = self.rows[runs] // BLOCK, np.append(runs, len(self.rows))
        self.run_most = np.maximum.reduceat(self.weights, runs) if len(runs) else np.zeros(0)
        self.term_runs = np.searchsorted(columns[runs], np.arange(n_columns + 1))

    def __getstate__(self):
        return self.__dict__ | {"dense": None}  # made again where it is used: it is mostly zeros

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None):
        """(examples, cosines) of the k nearest of each vector with cosine over 0, by cosine, then place; exact.

        but: an example for each vector that isn't its own neighbour.
        """
        if self.dense is None:
            self.dense = np.zeros((int(self.dense_of.max(initial=-1)) + 1, self.n_blocks * BLOCK))
            self.dense[self.full[:2]] = self.full[2]
        for at in range(0, len(vectors), TOGETHER):
            now = vectors[at : at + TOGETHER]
            frequent = np.zeros((len(now), len(self.dense)))
            for i, (columns, weights) in enumerate(now):
                place = self.dense_of[columns]
                frequent[i, place[place >= 0]] = weights[place >= 0]
            base = frequent @ self.dense
            for i, (columns, weights) in enumerate(now):
                rare = self.dense_of[columns] < 0
                yield self._best(base[i], columns[rare], weights[rare], k, but[at + i] if but else -1)

    def _best(self, base: np.ndarray, columns: np.ndarray, weights: np.ndarray, k: int, but: int) -> tuple[np.ndarray, np.ndarray]:
        runs, n = _ranges(self.term_runs[columns], self.term_runs[columns + 1])
        weight, block = np.repeat(weights, n), self.run_block[runs]
        starts, ends = self.run_start[runs], self.run_start[runs + 1]
        bound = np.bincount(block, weight * self.run_most[runs], minlength=self.n_blocks) + base.reshape(-1, BLOCK).max(axis=1)
        order = np.argsort(-bound, kind="stable")
        best_rows, best = np.zeros(0, np.int64), np.zeros(0)
        for now in (order[:FIRST], order[FIRST:]):
            now = now[bound[now] > 0]
            if len(best) >= k:
                now = now[bound[now] >= best[k - 1] - 1e-9]
            if not len(now):
                break
            visited = np.zeros(self.n_blocks, bool)
            visited[now] = True
            own = np.flatnonzero(visited[block])
            entries, m = _ranges(starts[own], ends[own])
            score = base + np.bincount(self.rows[entries], np.repeat(weight[own], m) * self.weights[entries], minlength=len(base))
            score[~np.repeat(visited, BLOCK)] = 0.0
            if but >= 0:
                score[but] = 0.0
            least = max(np.partition(score, -k)[-k], best[k - 1] if len(best) >= k else 0.0) if len(score) > k else 0.0
            found = np.flatnonzero((score > 0) & (score >= least - 1e-9))
            best_rows, best = np.concatenate([best_rows, found]), np.concatenate([best, score[found]])
            keep = np.lexsort((best_rows, -np.round(best, 9)))[:k]
            best_rows, best = best_rows[keep], best[keep]
        return best_rows, best


@dataclass
class Model:
    """terms: those of the examples, in rising order; weights: idf * relevance of each; other: of all other terms."""

    terms: np.ndarray
    weights: np.ndarray
    other: float
    ids: np.ndarray
    labels: np.ndarray
    rates: np.ndarray
    share: float
    index: Index
    steps: tuple[np.ndarray, np.ndarray]

    def _lengths(self, text: np.ndarray, columns: np.ndarray, others: np.ndarray) -> np.ndarray:
        w = self.weights[columns]
        return np.maximum(1e-12, np.sqrt(np.bincount(text, w * w, minlength=len(others)) + others * self.other**2))

    def vectors(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(columns, weights) of the terms of each text that examples have; the weights are those of its unit vector."""
        hashes, text, place, counts = stem_counts(texts)
        first = np.searchsorted(self.terms, hashes)  # a stem's levels stand together, without gaps
        known = np.minimum((np.searchsorted(self.terms, hashes | LEVELS, "right") - first)[place], n := reached(counts))
        columns, _ = _ranges(first[place], first[place] + known)
        both = np.sort(np.repeat(text, known) * len(self.terms) + columns)
        text_of, columns = both // len(self.terms), both % len(self.terms)
        lengths = self._lengths(text_of, columns, np.bincount(text, n - known, minlength=len(texts)))
        weights = self.weights[columns] / lengths[text_of]
        ends = np.searchsorted(text_of, np.arange(len(texts) + 1))
        return [(columns[i:j], weights[i:j]) for i, j in zip(ends[:-1], ends[1:])]

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        near = self.rates[rows] / (1.0 - np.minimum(cosines, 1.0) + EPS)
        return float((near @ self.labels[rows] + PRIOR * self.share) / (near.sum() + PRIOR))

    def judged(self, texts) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Scores of the texts (an Arrow column), and of each the nearest examples (places in the index) with
        their cosines."""
        found = list(self.index.nearest(self.vectors(texts), NEIGHBOURS))
        return np.interp([self.vote(*f) for f in found], *self.steps), found


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising function from x to the weighted mean of y, by pooling adjacent violators.

    Equal x are one point. Values are drawn half an example towards one half after pooling. The first
    coordinates rise strictly.
    """
    xs, at = np.unique(np.round(x, 12), return_inverse=True)
    sums = [np.bincount(at, v, minlength=len(xs)) for v in (weight * y, weight, np.ones(len(y)))]
    pools: list[list[float]] = []
    for v, t, w, n in zip(xs.tolist(), *(s.tolist() for s in sums)):
        pools.append([v, v, t, w, n])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            b, a = pools.pop(), pools[-1]
            pools[-1] = [a[0], b[1], a[2] + b[2], a[3] + b[3], a[4] + b[4]]
    points = [(v, (t / w * n + 0.5) / (n + 1)) for lo, hi, t, w, n in pools for v in ([lo] if lo == hi else [lo, hi])]
    if not points:
        return np.zeros(1), np.zeros(1)
    return np.array([p[0] for p in points]), np.maximum.accumulate([p[1] for p in points])


def _docs(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def sample(labels: DataFrame, examples: int = EXAMPLES) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """((doc_id, toxic) of `examples` labelled rows of each class at most, by hash; rows of each class)."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    own = materialise(own, "labels")
    total = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    pick = lambda v: own.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    return [(r.doc_id, r.toxic) for r in pick(1).unionAll(pick(0)).collect()], total


def frequencies(docs: DataFrame, stems: np.ndarray) -> np.ndarray:
    """In how many rows of docs each of the stems (numbers without a level, in rising order) occurs, and how
    many rows there are. A task counts into one array, so what is shuffled is one row a task and stem."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(stems)

    def tally(it):
        own, n = np.zeros(len(sent.value), np.int64), 0
        for b in slices(it):
            hashes, _, place, _ = stem_counts(b.column(0))
            at = np.minimum(np.searchsorted(sent.value, hashes), len(own) - 1)
            known = sent.value[at] == hashes
            np.add.at(own, at[known], np.bincount(place, minlength=len(hashes))[known])
            n += b.num_rows
        have = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(have, -1), pa.int64()), pa.array(np.append(own[have], n), pa.int64())], ["stem", "df"])

    each = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tally, "stem long, df long")
    counted = each.groupBy("stem").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(stems) + 1, np.int64)
    out[counted.column("stem").to_numpy()] = counted.column("df").to_numpy()
    sent.destroy()
    return out


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model | None:
    """A model from the labels given; frequencies are counted over all docs. None without labels of both classes."""
    spark = prepare(docs.sparkSession)
    chosen, total = sample(labels, examples)
    known = spark.createDataFrame(chosen, "__id long, __toxic int")
    labelled = _docs(docs).join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    labelled = labelled.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("__toxic").alias("toxic"))

    def vectors(it):
        for b in slices(it):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), terms_of(b.column(1))], ["doc_id", "toxic", "terms"])

    table = materialise(labelled.mapInArrow(vectors, "doc_id long, toxic int, terms array<bigint>"), "vectors")
    own = table.toArrow()  # `examples` rows of each class at most
    toxic = own.column("toxic").to_numpy()
    if not 0 < toxic.sum() < len(toxic):
        return None
    stems = np.unique(own.column("terms").combine_chunks().flatten().to_numpy() & ~LEVELS)
    if not len(stems):
        return None
    model = _model(own, stems, frequencies(docs, stems), total)
    sent = spark.sparkContext.broadcast((model, {int(i): at for at, i in enumerate(model.ids)}))

    def votes(it):
        own, place = sent.value
        for b in it:
            columns = [np.searchsorted(own.terms, t.values.to_numpy()) for t in b.column(1)]
            lengths = [own._lengths(np.zeros(len(c), np.int64), c, np.zeros(1))[0] for c in columns]
            found = own.index.nearest([(c, own.weights[c] / n) for c, n in zip(columns, lengths)], NEIGHBOURS, [place[i] for i in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.vote(*f) for f in found], pa.float64())], ["doc_id", "vote"])

    spread = table.select("doc_id", "terms").repartition(spark.sparkContext.defaultParallelism)
    by_id = {r.doc_id: r.vote for r in spread.mapInArrow(votes, "doc_id long, vote double").collect()}
    sent.destroy()
    model.steps = isotonic(np.array([by_id[int(i)] for i in model.ids]), model.labels, model.rates)
    return model


def _model(own: pa.Table, stems: np.ndarray, df: np.ndarray, total: dict[int, int]) -> Model:
    """The model of the examples (doc_id, toxic, terms), without calibration."""
    toxic, ids = own.column("toxic").to_numpy().astype(np.int64), own.column("doc_id").to_numpy()
    lists = own.column("terms").combine_chunks()
    n, lengths = len(toxic), lists.value_lengths().to_numpy().astype(np.int64)
    terms, columns = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    rows = np.repeat(np.arange(n), lengths)
    n_docs, df = int(df[-1]), df[np.searchsorted(stems, terms & ~LEVELS)].astype(float)

    # Copies of one text count once in the relevance, else a copied text's own words would look telling.
    ends = np.cumsum(lengths)
    single = np.zeros(n, bool)
    single[list({columns[e - m : e].tobytes(): i for i, (e, m) in enumerate(zip(ends, lengths))}.values())] = True
    by_class = [np.bincount(columns[(single & (toxic == v))[rows]], minlength=len(terms)).astype(float) for v in (1, 0)]
    ratio = _log_ratio(*by_class, *[max(1.0, float((single & (toxic == v)).sum())) for v in (1, 0)])
    weights = np.log((n_docs + 1.0) / (df + 0.5)) * (1.0 + np.log1p(np.maximum(0.0, ratio - telling(len(terms)))))

    rates = np.array([total.get(v, 0) for v in (0, 1)])[toxic] / np.bincount(toxic, minlength=2)[toxic]
    share = float(rates @ toxic / rates.sum())
    w = weights[columns]
    w = w / np.maximum(1e-12, np.sqrt(np.bincount(rows, w * w, minlength=n)))[rows]

    # Examples with the same heaviest term stand together, which makes the blocks' bounds sharp.
    heaviest = np.full(n, -1)
    by_weight = np.argsort(w, kind="stable")
    heaviest[rows[by_weight]] = columns[by_weight]
    placed = np.lexsort((ids, heaviest))
    place = np.empty(n, np.int64)
    place[placed] = np.arange(n)
    other = math.log((n_docs + 1.0) / (n_docs / n + 0.5))
    index = Index(n, len(terms), columns, place[rows], w)
    return Model(terms, weights, other, ids[placed], toxic[placed].astype(float), (rates / rates.mean())[placed], share, index, (np.zeros(1), np.zeros(1)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, near (doc_ids of the nearest examples) and cosines (theirs) of each row of docs."""
    shape = "doc_id long, score double, near array<bigint>, cosines array<double>"
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.array().cast("array<bigint>").alias("near"), F.array().cast("array<double>").alias("cosines"))
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def batches(it):
        own = sent.value
        for b in slices(it):
            scores, found = own.judged(b.column(1))
            near = [pa.array([own.ids[rows] for rows, _ in found], pa.list_(pa.int64())), pa.array([cosines for _, cosines in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), *near], ["doc_id", "score", "near", "cosines"])

    return _docs(docs).mapInArrow(batches, shape)


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with all its columns, without rows that score `threshold` or more."""
    if model is None:
        return docs
    sent, at = prepare(docs.sparkSession).sparkContext.broadcast(model), docs.columns.index("text")

    def batches(it):
        own = sent.value
        for b in slices(it):
            yield b.filter(pa.array(own.judged(b.column(at))[0] < threshold, pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
