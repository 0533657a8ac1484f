"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at r or fewer differing bits have a common variant within ceil(r / 2) of both. Every
distinct fingerprint therefore emits its ball of that radius (65 variants for r = 2), the variants are
shuffled, and fingerprints that meet on a variant are verified by a population count.

Size of a variant's group: distinct fingerprints within r / 2 of one word, at most 65 for r = 2,
however many documents share them: copies are folded into one fingerprint before the shuffle.
Inside a group (even r) all members lie within r of one another, so linking neighbours in sorted
order keeps the group connected and no pairs are enumerated.

Defined cases: null and blank texts have no shingle and fingerprint zero, linked like any other;
texts of fewer than `width` words hash their whole word sequence; a bit that is set in exactly half of the hashes (a tie) is 0;
very long texts are counted CHUNK shingles at a time; repeated rows get equal values; a
null doc_id takes part but is never a component's name (null if no member has an id); columns other
than doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ._common import materialise, prepare, slices
from .components import connected_components

#: Shingles whose bits are counted at once, which bounds the memory of a very long text.
CHUNK = 1 << 15


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that are set in over half of n hashes, as an unsigned number."""
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles, repeats included, as an unsigned number."""
    words = (text or "").encode().lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    runs = [words[i:] for i in range(width)] if len(words) >= width else [[b" ".join(words)]]
    shingles = map(b" ".join, zip(*runs)) if len(words) >= width else iter(runs[0])
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, dtype=np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    for start in range(0, n, CHUNK):
        counts += bit_counts(np.fromiter(hashes, dtype=">u8", count=min(CHUNK, n - start)))
    return majority(counts, n)


def with_fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, of each row."""
    prepare(docs.sparkSession)

    def batches(it):
        for b in slices(it):
            fps = [fingerprint(t, width, seed) for t in b.column(1).to_pylist()]
            fps = pa.array(np.array(fps, dtype=np.uint64).view(np.int64) if fps else [], type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(batches, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """XOR masks of all 64-bit words with at most `radius` set bits, as signed numbers."""
    masks = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(64), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Verified pairs (a, b) of distinct fingerprints at `bits` or fewer differing bits, enough of
    them to connect all that are linked. fps has a column fp without repeats. Only for even `bits`."""
    if bits % 2 or not 0 <= bits <= 4:
        raise ValueError("bits must be 0, 2 or 4")
    mask = F.explode(F.array(*[F.lit(m).cast("long") for m in ball(bits // 2)]))
    variants = fps.select("fp", mask.alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    met = Window.partitionBy("variant").orderBy("fp")
    pairs = variants.select(F.lag("fp").over(met).alias("a"), F.col("fp").alias("b")).where("a is not null")
    return pairs.where(F.expr(f"bit_count(a ^ b) <= {bits}")).distinct()


def by_component(rows: DataFrame, linked) -> DataFrame:
    """doc_id, fp and component_id of rows (doc_id, fp); linked gives the links of the distinct fps."""
    reps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = connected_components(linked(reps.select("fp")))
    placed = reps.join(roots, reps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, bits: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links, itself included) per row."""
    return by_component(materialise(with_fingerprints(docs, width, seed), "fingerprints"), lambda fps: links(fps, bits))


def only_named(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with all its columns, only the rows that found (doc_id, component_id) names components by."""
    # Null-safe keys as plain columns: the join's partitioning then serves dropDuplicates as well. The row itself
    # is one column, so that no name of it clashes.
    key = {"id": lambda c: F.coalesce(c.cast("long"), F.lit(0)), "none": lambda c: c.isNull()}
    kept = found.where("doc_id <=> component_id").select(*[f(F.col("doc_id")).alias(k) for k, f in key.items()]).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("own"), *[f(docs["doc_id"]).alias(k) for k, f in key.items()])
    return rows.join(kept.hint("shuffle_hash"), [*key], "left_semi").dropDuplicates([*key]).select("own.*")


def keep_one(docs: DataFrame, bits: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """docs with all its columns, of each component only the row named by component_id.

    Rows that repeat a doc_id count as one document and one of them stays; rows without an id stay
    only where their component has no id at all.
    """
    return only_named(docs, near_duplicates(docs, bits, width, seed))
