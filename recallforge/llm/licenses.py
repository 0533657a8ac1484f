r"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed (64 bits, from the XXH64 of their words), and Spark joins all of them to
the positions of the same k-grams in license templates (a fixed, small table, broadcast). Each match
votes for the diagonal text position - template position; votes are added per diagonal, neighbouring
diagonals (words put in or left out) are merged, and the merged span is verified: the share of template
words it covers, against the longer of template and span. Templates may have any number of words.

A template's version numbers tell licenses apart that share all other words, so the main number of each
("2" of "2.0", as "Version 2" is often written alone) must be among the covered words.

Phrases are templates that count only whole: their places are the base labels. Templates need a
similarity of `least`.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z in lower case, numbered from 0.
Defined cases: null and empty texts have no words, no places, empty label strings and score 0; rows
that repeat a doc_id are scanned one by one; of templates that cover a place alike (ties) all count; very long texts
are hashed whole, a few at a time; extra columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ._common import prepare, slices

#: Longest k-gram; templates with fewer words use k-grams of their own length.
K = 3
#: Similarity from which a template counts.
LEAST = 0.8

#: Base phrases and their labels (fixed values).
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]
#: Notices and their labels.
NOTICES = [
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Licensed under the BSD 3-Clause License", "bsd-3-clause"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("licensed under the GNU General Public License, version 2", "gpl-2.0"),
    ("licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("GNU Lesser General Public License", "lgpl"),
    ("GNU Affero General Public License", "agpl"),
    ("subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("Licensed under CC BY 4.0", "cc-by-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("released into the public domain", "public-domain"),
]

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Odd factors of the places of a k-gram (fixed values: any odd numbers of 64 bits do).
_FACTORS = np.random.default_rng(0).integers(0, 1 << 64, K + 1, dtype=np.uint64) | np.uint64(1)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, as signed numbers; the words are given by their hashes."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, np.uint64) * _FACTORS[K]
    for i in range(k):
        out += hashes[i : i + n] * _FACTORS[i]
    return _mixed(out).view(np.int64)


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


@dataclass(frozen=True)
class Template:
    words: tuple[bytes, ...]
    label: str
    base: bool

    @property
    def k(self) -> int:
        return min(K, len(self.words))

    @property
    def numbers(self) -> list[int]:
        """Places of the words that are the main part of a number."""
        digit = [w.isdigit() for w in self.words]
        return [i for i, d in enumerate(digit) if d and not (i and digit[i - 1])]


def templates(phrases=PHRASES, notices=NOTICES) -> list[Template]:
    out = [Template(tuple(words(t)), label, base) for own, base in ((phrases, True), (notices, False)) for t, label in own]
    if not all(t.words for t in out):
        raise ValueError("a template has a word at least")
    return out


def positions(spark: SparkSession, known: list[Template]) -> DataFrame:
    """gram, template, k, tpos of every k-gram of the templates; the row with k 0 is the one that each text has."""
    rows = [(int(g), n, t.k, p) for n, t in enumerate(known) for p, g in enumerate(rolling(word_hashes(list(t.words)), t.k))]
    return spark.createDataFrame([(0, -1, 0, 0), *rows], "gram long, template int, k int, tpos int")


def _catalogue(spark: SparkSession, known: list[Template]) -> DataFrame:
    rows = [(n, t.label, t.base, len(t.words), t.k, 0 if t.base else max(1, len(t.words) // 8), t.numbers) for n, t in enumerate(known)]
    return spark.createDataFrame([(-1, None, False, 1, 1, 0, []), *rows], "template int, label string, base boolean, length int, k int, slack int, numbers array<int>")


def text_grams(docs: DataFrame, known: list[Template]) -> DataFrame:
    """row (a number of its own for each row), doc_id, n_words and grams of each row: the hashes of all its
    k-grams, for each k that templates have in rising order, then a 0."""
    prepare(docs.sparkSession)
    ks = sorted({t.k for t in known})

    def batches(it):
        for b in slices(it):
            texts = [words(t.as_py()) for t in b.column(2)]
            coded = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
            hashes = word_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
            ends = np.cumsum([0, *map(len, texts)])
            runs = [np.concatenate([*(rolling(hashes[i:j], k) for k in ks), [0]]) for i, j in zip(ends[:-1], ends[1:])]
            starts = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            grams = pa.ListArray.from_arrays(starts, pa.array(np.concatenate(runs) if runs else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends), pa.int64()), grams], ["row", "doc_id", "n_words", "grams"])

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(batches, "row long, doc_id long, n_words long, grams array<bigint>")


def _at(known: list[Template]) -> Column:
    """Word at which the gram at place p of a text's grams starts."""
    out, before = F.lit(-1).cast("long"), F.lit(0).cast("long")
    for k in sorted({t.k for t in known}):
        out = F.when(F.col("k") == k, F.col("p") - before).otherwise(out)
        before = before + F.greatest(F.lit(0).cast("long"), F.col("n_words") - (k - 1))
    return out


def spans(docs: DataFrame, least: float = LEAST, known: list[Template] | None = None) -> DataFrame:
    """Verified spans: row, doc_id, n_words, label, base, start, end (words, end exclusive), similarity.

    Each text also has one row without a label, so that texts without a license stay in the result.
    """
    known, spark = known or templates(), docs.sparkSession
    flat = text_grams(docs, known).select("row", "doc_id", "n_words", F.posexplode("grams").alias("p", "gram"))
    votes = flat.join(F.broadcast(positions(spark, known)), "gram").select("row", "doc_id", "n_words", "template", _at(known).alias("at"), "tpos")
    # A text's votes meet in one task: their number is bounded by its own length and the templates'.
    votes = votes.repartition("row").withColumn("diagonal", F.col("at") - F.col("tpos"))
    lines = votes.groupBy("row", "template", "diagonal").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_set("tpos").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    lines = lines.join(F.broadcast(_catalogue(spark, known)), "template")
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack")
    lines = lines.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("cluster", F.sum("new").over(along))
    merged = lines.groupBy("row", "template", "cluster").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "n_words", "label", "base", "length", "k")], F.first("numbers").alias("numbers"),
        F.flatten(F.collect_list("places")).alias("places"), F.min("first").alias("start"), F.max("last").alias("last"),
    )
    merged = merged.withColumn("covered", F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    merged = merged.where((F.col("template") < 0) | (F.size(F.array_except("numbers", "covered")) == 0))
    end = F.col("last") + F.col("k")
    similarity = F.when(F.col("template") < 0, 0.0).otherwise(F.size("covered") / F.greatest(F.col("length").cast("long"), end - F.col("start")))
    out = merged.select("row", "doc_id", "n_words", "label", "base", "start", end.alias("end"), similarity.alias("similarity"))
    return out.where(F.col("label").isNull() | (F.col("similarity") >= F.when(F.col("base"), 1.0).otherwise(least)))


def scan(docs: DataFrame, least: float = LEAST, known: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs."""
    start = F.when(F.col("base"), F.col("start"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    out = spans(docs, least, known).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count(start).alias("n_base"),
        F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.max("similarity").alias("score"),
    )
    return out.drop("row")
