"""Sharding by extendible hashing, in DataFrame operations only.

The directory is indexed by the leading bits of a row's hash. It starts with one bucket; only buckets
over the byte limit split on another bit, so depths differ and every shard ends within the limit.
Sizes of all prefixes of `step` bits come from one aggregation of at most 2 ** step rows for each
bucket that is still too large, so a round needs no more than that per bucket and rounds are few.

The hash is an MD5 digest of the key (doc_id), KEY_BITS bits of it, in rounds of `step`. Rows that share a
key would never part, so where the rows of one key exceed the limit the following bits come from the
row: a hash of its text and of its number among the rows with the same key and text. A key that
holds a third of all rows splits like any other bucket, and how many of its rows go where doesn't
depend on how the input is laid out. Those numbers are made from counts per input partition, so no key's rows meet in one
task.

Only a row that is larger than the limit by itself can make a shard too large; it then is alone or
among rows that all hash alike in BITS bits.

Defined cases: null text has 0 bytes; a null doc_id hashes as the empty string; repeated rows may go
to different shards only when they must; very long texts count with all their bytes; `assign` reads doc_id and
text, `write` keeps all columns; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ._common import materialise, scratch_path

#: Hash bits in all, and those that a row's key decides.
BITS, KEY_BITS = 60, 36


def hashed(docs: DataFrame, limit: int, *kept: str) -> DataFrame:
    """The columns of docs named in `kept` (as a struct, so that no name clashes), bytes and h (BITS bits) of each row."""
    own = F.struct(*[docs[c] for c in kept]).alias("own")
    text, size = docs["text"].cast("string"), F.coalesce(F.octet_length(docs["text"].cast("string")), F.lit(0)).cast("long")
    key = F.conv(F.substring(F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = docs.select(own, size.alias("bytes"), key.alias("key"), F.xxhash64(text).alias("content"))
    hot = materialise(rows.groupBy("key").agg(F.sum("bytes").alias("all"), F.count("*").alias("n")).where((F.col("all") > limit) & (F.col("n") > 1)).select("key"), "hot")
    plain = lambda df, more: df.select("own", "bytes", (F.shiftleft("key", BITS - KEY_BITS) + more).alias("h"))
    if not hot.take(1):
        return plain(rows, F.lit(0).cast("long"))
    spread = materialise(rows.join(hot, "key", "left_semi").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "spread")
    before = Window.partitionBy("key", "content").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("key", "content", "part").agg(F.count("*").alias("n")).select("key", "content", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("key", "content", "part").orderBy("place"))
    numbered = spread.withColumn("nth", within).join(counts, ["key", "content", "part"])
    own_bits = F.pmod(F.xxhash64("content", F.col("before") + F.col("nth")), F.lit(1 << (BITS - KEY_BITS)))
    return plain(rows.join(hot, "key", "left_anti"), F.lit(0).cast("long")).unionAll(plain(numbered, own_bits))


def _round(rows: DataFrame, done: int, up: int, limit: int, bits: int) -> DataFrame:
    """Leaves (code, depth, docs, size) below the buckets of `done` bits that rows fall in; leaves of
    `up` bits may still be too large."""
    cut = F.shiftrightunsigned("h", bits - up)
    hist = rows.groupBy(cut.alias("prefix")).agg(F.count("*").alias("docs"), F.sum("bytes").alias("size"))
    levels = hist.select("prefix", "docs", "size", F.explode(F.sequence(F.lit(done), F.lit(up))).alias("depth"))
    code = F.expr(f"shiftrightunsigned(prefix, {up} - depth)")
    sums = levels.groupBy("depth", code.alias("code")).agg(F.sum("docs").alias("docs"), F.sum("size").alias("size"))
    fits = F.col("size") <= limit
    over = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("code").alias("parent"))
    whole = sums.where(fits | (F.col("depth") == up))
    below = whole.join(over, (whole["depth"] == over["depth"]) & (F.shiftrightunsigned(whole["code"], 1) == over["parent"]), "left_semi")
    top = whole.where(F.col("depth") == done) if done == 0 else whole.limit(0)
    return below.unionByName(top).select("depth", "code", "docs", "size")


def directory(rows: DataFrame, limit: int, step: int = 12, bits: int = BITS) -> DataFrame:
    """depth, code (the leading bits as a number), docs, size of every bucket. rows has h, of which the lowest
    `bits` bits count, and bytes."""
    done, leaves, active = 0, [], rows
    while done < bits:
        up = min(done + step, bits)
        found = materialise(_round(active, done, up, limit, bits), "leaves")
        done, last = up, up >= bits
        open_ = (F.col("depth") == done) & (F.col("size") > limit)
        leaves.append(found.where(F.lit(last) | ~open_))
        if last or not found.where(open_).take(1):
            break
        too_large = found.where(open_).select(F.col("code").alias("__code"))
        active = active.join(too_large, F.shiftrightunsigned("h", bits - done) == F.col("__code"), "left_semi")
    return reduce(DataFrame.unionByName, leaves)


def _placed(docs: DataFrame, limit: int, step: int, *kept: str) -> DataFrame:
    """own, shard, depth, bytes, shard_docs, shard_bytes of each row."""
    rows = hashed(docs, limit, *kept)
    rows = materialise(rows, "hashed") if kept == ("doc_id",) else rows
    shards = materialise(directory(rows.select("bytes", "h"), limit, step), "directory")
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())  # at most BITS + 1 numbers
    for d in depths:
        code = F.shiftrightunsigned("h", BITS - d) if d else F.lit(0).cast("long")
        rows = rows.withColumn(f"code{d}", code)
    codes = F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"code{d}").alias("code")) for d in depths]) if depths else F.array().cast("array<struct<depth:int,code:bigint>>")
    probe = rows.select("own", "bytes", F.explode(codes).alias("p")).select("own", "bytes", "p.depth", "p.code")
    name = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("code"), 10, 2), F.col("depth"), F.lit("0")))
    return probe.join(shards, ["depth", "code"]).select("own", name.alias("shard"), "depth", "bytes", F.col("docs").alias("shard_docs"), F.col("size").alias("shard_bytes"))


def assign(docs: DataFrame, limit: int = 1 << 30, step: int = 12) -> DataFrame:
    """doc_id, shard (the bits of its prefix; '' is the only shard), depth, bytes, shard_docs, shard_bytes."""
    return _placed(docs, limit, step, "doc_id").select("own.doc_id", "shard", "depth", "bytes", "shard_docs", "shard_bytes")


def write(docs: DataFrame, path: str | None = None, limit: int = 1 << 30, step: int = 12) -> str:
    """Write docs, all its columns and each row once, as one folder of Parquet files per shard (shard=x<bits>);
    returns the path. Where docs has a column `shard`, the folders are named shard_=x<bits>, and so on."""
    path, name = path or scratch_path(docs.sparkSession, "shards"), "shard"
    while name in docs.columns:
        name += "_"
    found = _placed(docs, limit, step, *docs.columns).select("own.*", F.concat(F.lit("x"), "shard").alias(name))
    found.repartition(name).write.partitionBy(name).parquet(path)
    return path
