r"""Exact duplicates through an extendible-hash index on shared files, in DataFrame operations only.

1. Every text is normalised (white space `[\x20\x09-\x0D]` deleted) and hashed to a 64-bit key. A narrow table
   holds each row's key, digest, length and rank, but no text.
2. The directory is made of the distinct keys: it starts with one bucket; buckets with more than
   `bucket_entries` keys split on the next bit (the directory doubles) until none is overfull. Where keys are
   so many that the directory would exceed DIRECTORY buckets, buckets hold proportionally more, so the
   directory is small enough to broadcast at every size.
3. Texts are routed through the directory to their bucket and folded there into the entries of a key's chain: one
   entry for each distinct byte string, told apart by comparing the bytes, so collisions of the hash
   end in separate entries. Partial aggregation folds copies before the shuffle: a text that a third of all
   rows share leaves each task once.
4. The entries, without texts, go to shared files in the order of bucket and key; owner tasks each
   hold a range of buckets. Rows are routed through the same directory and look their entry up in their
   bucket, by key and then along the chain by digest and length. That join is skewed by hot texts but
   carries narrow rows only, and Spark splits its skewed partitions.

Which row stays: of equal texts the one with the most code points in the original text, then the
smallest doc_id (null last). Defined cases: null text counts as empty and all blank texts are equal;
of rows that repeat doc_id and text exactly one is kept; very long texts are compared whole; extra columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._common import BLANKS, materialise
from .sharding import directory

#: Keys of a bucket at most, and buckets from which on they grow with the number of keys.
BUCKET_ENTRIES, DIRECTORY = 512, 1 << 15
#: Prefixes that a lookup of the directory is spread to, at most.
SLOTS = 1 << 17

#: 2 ** 63 and 2 ** 65 as SQL decimals: an id is stored as 2 ** 63 - id, and below points * 2 ** 65.
_TOP, _STEP = "cast(9223372036854775808 as decimal(38,0))", "cast(36893488147419103232 as decimal(20,0))"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def _rank() -> Column:
    """One number that orders rows by points, then by smaller doc_id, null last."""
    return F.expr(f"cast(cast(points as decimal(38,0)) * {_STEP} + coalesce({_TOP} - cast(doc_id as decimal(38,0)), 0) as decimal(38,0))")


def _ranked_id(rank: str) -> Column:
    """The doc_id in a number made by _rank."""
    return F.expr(f"if({rank} % {_STEP} = 0, null, cast({_TOP} - {rank} % {_STEP} as bigint))")


def hashed(norm: Column) -> Column:
    """The key of a normalised text."""
    return F.xxhash64(norm)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, norm (normalised text), key (64-bit hash) and points of each row."""
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), normalised(docs["text"]).alias("norm"), F.char_length(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("points"))
    return text.select("doc_id", "norm", hashed(F.col("norm")).alias("key"), "points")


def build_directory(keys: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """depth, code and entries of every bucket. keys has a column key without repeats."""
    most = max(bucket_entries, -(-keys.count() // DIRECTORY))
    found = directory(keys.select(F.col("key").alias("h"), F.lit(1).alias("bytes")), most, bits=64)
    return materialise(found.select("depth", "code", F.col("docs").alias("entries")), "directory")


def _levels(counts: dict[int, int]) -> list[list[int]]:
    """The depths in runs whose buckets have at most SLOTS prefixes at the run's last depth; usually one run."""
    out: list[list[int]] = []
    for d in sorted(counts):
        run = [*(out[-1] if out else []), d]
        if out and sum(counts[x] << (d - x) for x in run) <= SLOTS:
            out[-1] = run
        else:
            out.append([d])
    return out


def routed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows with bucket, the smallest number (as the bits of a long) that the bucket of their key holds; rows
    whose key has no bucket have null. A bucket stands at all its prefixes of the deepest bucket's length, so one
    lookup serves all depths; only where that would be more than SLOTS prefixes is there another one."""
    levels = _levels({r[0]: r[1] for r in buckets.groupBy("depth").count().collect()})  # 65 rows at most
    for i, run in enumerate(levels):
        d = run[-1]
        first = buckets.where(F.col("depth").isin(run)).select(F.expr(f"shiftleft(code, {d} - depth)").alias("slot"), F.expr(f"shiftleft(1L, {d} - depth) - 1").alias("more"), F.expr("shiftleft(code, 64 - depth)").alias(f"bucket{i}"))
        slots = first.select(F.explode(F.sequence("slot", F.col("slot") + F.col("more"))).alias(f"slot{i}"), f"bucket{i}")
        slot = F.shiftrightunsigned("key", 64 - d) if d else F.lit(0).cast("long")
        rows = rows.join(F.broadcast(slots), slot == F.col(f"slot{i}"), "left").drop(f"slot{i}")
    found = F.coalesce(*[F.col(f"bucket{i}") for i in range(len(levels))]) if levels else F.lit(None).cast("long")
    return rows.withColumn("bucket", found).drop(*[f"bucket{i}" for i in range(len(levels))])


def build_index(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """The index on shared files: bucket, key, digest, size, group_size, best; one entry per distinct text of
    rows (doc_id, norm, key, points), in the order of bucket and key."""
    chains = routed(rows, buckets).groupBy("bucket", "key", "norm").agg(F.count("*").alias("group_size"), F.max(_rank()).alias("best"))
    entries = materialise(chains.select("bucket", "key", F.sha2("norm", 256).alias("digest"), F.octet_length("norm").alias("size"), "group_size", "best"), "entries")
    return materialise(entries.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "index")


def duplicates(docs: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, points of each row of docs."""
    rows = keyed(docs)
    narrow = rows.select("doc_id", "key", F.sha2("norm", 256).alias("digest"), F.octet_length("norm").alias("size"), "points", F.monotonically_increasing_id().alias("place"))
    narrow = materialise(narrow, "narrow")
    buckets = build_directory(narrow.select("key").distinct(), bucket_entries)
    index = build_index(rows, buckets)
    entry = index.select("bucket", "key", "digest", "size", "group_size", "best")
    found = routed(narrow, buckets).join(entry, ["bucket", "key", "digest", "size"])
    # Rows that repeat doc_id and text are alike in rank; of those the one that stands first stays.
    found = materialise(found, "found")
    first = found.where(_rank() == F.col("best")).groupBy("key", "digest", "size").agg(F.min("place").alias("first"))
    out = found.join(first, ["key", "digest", "size"])
    return out.select("doc_id", _ranked_id("best").alias("keep_id"), "group_size", (F.col("place") == F.col("first")).alias("kept"), F.col("digest").alias("text_sha256"), "points")


def drop_copies(docs: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """docs with all its columns, of equal texts only the row that stays."""
    # Null-safe keys as plain columns: the join's partitioning then serves dropDuplicates as well. The row itself
    # is one column, so that no name of it clashes.
    key = ["id", "none", "sha", "points"]
    kept = duplicates(docs, bucket_entries).where("kept").select(F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.col("text_sha256").alias("sha"), "points")
    points = F.char_length(F.coalesce(docs["text"].cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("own"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("id"), docs["doc_id"].isNull().alias("none"), F.sha2(normalised(docs["text"]), 256).alias("sha"), points.alias("points"))
    return rows.join(kept.hint("shuffle_hash"), key, "left_semi").dropDuplicates(key).select("own.*")
