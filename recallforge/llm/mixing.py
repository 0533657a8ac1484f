r"""Mixing sources to target weights.

Words are counted per source (one partial sum per task and source, so a source with a third of all
rows is no hot group), targets follow from the weights, and each document is emitted floor(rate)
times plus one hash-seeded Bernoulli copy with probability equal to the fraction of the rate
target / source size.

Targets: sources in order of code points (null last) weigh `weights`, repeating, and share `share`
times all words. A target stops at `most` times its source's words and the excess is reshared by
weight among the others until none is above: a water level, found by rounds of one aggregation that
each return three sums to the driver. The sources' table stays distributed.

Defined cases: null text has size 0; very long texts count whole; sources of equal size (ties) keep the order of their code points; sources without words get target 0 and rate 0; repeated rows of
one doc_id draw the same number; a null doc_id draws as the empty string; only doc_id, text and source
are read, other columns pass through `mix`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import materialise

#: Targets are rounded to so many decimals, so that the order of floating-point sums leaves no trace.
DECIMALS = 4


def size_of(text: Column) -> Column:
    r"""Words `[^\x20\x09-\x0D]+`."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weighed(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sources (source, words) with w, by place in the order of code points. Places come from a distributed sort:
    the rows before a partition, counted per partition, and the row's number in its own."""
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id())
    ordered = materialise(ordered, "ordered")
    first = ordered.groupBy("part").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    first = first.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("nth") - F.col("first")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights)).cast("int"))
    return ordered.join(F.broadcast(first), "part").select("source", "words", w.alias("w"))


def targets(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, words, w, target of each source. docs has source and size."""
    found = docs.groupBy("source").agg(F.sum("size").alias("words"))
    table = materialise(_weighed(found, weights), "sources")
    goal, full = share * (table.agg(F.sum("words")).first()[0] or 0), F.lit(False)
    level = 0.0
    while True:
        left = table.where(~full).agg(F.sum("w")).first()[0]
        kept = table.where(full).agg(F.sum(F.col("words") * most)).first()[0] or 0.0
        if not left:
            break
        level = (goal - kept) / left
        above = F.col("w") * F.lit(level) > F.col("words") * most
        if not table.where(~full & above).take(1):
            break
        full = above  # the level only rises, so what was full stays full
    target = F.when(full, F.col("words") * most).otherwise(F.least(F.col("w") * F.lit(level), F.col("words") * most))
    return table.select("source", "words", "w", F.round(target, DECIMALS).alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that only the doc_id and the seed decide: 52 bits of an MD5 digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def assign(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 5) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies of each row of docs."""
    sized = docs.select("doc_id", docs["source"].cast("string").alias("source"), size_of(docs["text"]).alias("size"))
    by = targets(sized, weights, share, most).select(F.col("source").alias("__s"), F.col("words").alias("source_size"), "target")
    joined = sized.join(by, sized["source"].eqNullSafe(F.col("__s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = joined.select("doc_id", "source", "size", "source_size", "target", rate.alias("rate"))
    copies = F.floor("rate") + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rated.withColumn("copies", copies.cast("int"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 5) -> DataFrame:
    """docs with all its columns, each row as often as it is taken."""
    sized = docs.select(docs["source"].cast("string").alias("source"), size_of(docs["text"]).alias("size"))
    by = targets(sized, weights, share, most)
    by = by.select(F.col("source").alias("__s"), F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0)).alias("__rate"))
    rated = docs.join(by, docs["source"].cast("string").eqNullSafe(F.col("__s")))
    copies = F.floor("__rate") + F.when(draw(docs["doc_id"], seed) < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    return rated.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*[docs[c] for c in docs.columns])
