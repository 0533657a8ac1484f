"""The operators' registered queries, each over its whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, licenses, media, mixing, pii, sharding, simhash, toxicity, warc
from ._common import table


#: Byte limit of a shard in op6_sharding.
SHARD_BYTES = 1 << 20


def tokenizer_path() -> str:
    """The byte-level vocabulary of the public tokenizers package."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(spark, warc.write(table(spark, sf_dir, "pages")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model | None:
    """Learnt from the labelled rows that aren't held out."""
    return toxicity.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "near", "cosines")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store(table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 4)
    counts = [pii.number(F.col("spans"), k).alias(f"n_{k}") for k in pii.KINDS[:4]]
    top = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score")
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), top)


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_media": op9_media,
    "op10_pii": op10_pii,
}

ORACLE_SQL = {
    "op2_warc": r"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
             d AS (SELECT *, array_to_string(list_transform(range(32), lambda i:
                       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), '') AS payload_digest,
                       max(page_id) OVER (PARTITION BY h) AS original FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> original THEN original END AS refers_to
        FROM d
    """,
    "op6_sharding": r"""
        WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 9))::BIGINT AS h FROM documents),
             l AS (SELECT depth, h >> (36 - depth) AS code, count(*) AS docs, sum(bytes)::BIGINT AS size
                   FROM d, (SELECT unnest(generate_series(0, 24)) AS depth) GROUP BY ALL),
             leaf AS (SELECT l.* FROM l LEFT JOIN l AS up ON up.depth = l.depth - 1 AND up.code = l.code >> 1
                      WHERE l.size <= 1048576 AND (l.depth = 0 OR up.size > 1048576))
        SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(code), depth::INT, '0') END AS shard, depth::INT AS depth, bytes, docs AS shard_docs, size AS shard_bytes
        FROM d JOIN leaf ON d.h >> (36 - leaf.depth) = leaf.code
    """,
    "op5_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
             s AS (SELECT source, sum(size)::DOUBLE AS n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
             o AS (SELECT *, coalesce(sum(2 * n) OVER before, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left, 1.5 * sum(n) OVER () AS goal
                   FROM s WINDOW before AS (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
             l AS (SELECT first((goal - full_before) / w_left ORDER BY n / w, source) FILTER ((goal - full_before) / w_left * w <= 2 * n) AS level FROM o),
             t AS (SELECT source, n::BIGINT AS source_size, round(least(w * level, 2 * n), 4) AS target FROM s, l),
             r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
                   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('5:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
        FROM r
    """,
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
                   FROM documents)
        SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
}
