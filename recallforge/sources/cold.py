"""Cold vectors: embeddings apart from their segment, raw, as half floats or as eight-bit codes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.quantize import f16_bytes, f16_vector, sq8_codes, sq8_decode, sq8_scale
from ..session import prepare

ENCODINGS = ("raw", "f16", "sq8")
#: Bytes of one value of an embedding.
WIDTH = {"raw": 4, "f16": 2, "sq8": 1}


def encode(records: DataFrame, encoding: str) -> DataFrame:
    """local_id and the stored form: vec (array<float>), half (binary) or codes (array<tinyint>) + scale."""
    prepare(records.sparkSession)
    if encoding == "raw":
        return records.select("local_id", F.col("embedding").alias("vec"))
    if encoding == "f16":
        def halves(it):
            for b in it:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if v is None else f16_bytes(v) for v in b.column(1).to_pylist()], pa.binary())], ["local_id", "half"])

        return records.select("local_id", "embedding").mapInArrow(halves, "local_id int, half binary")
    if encoding == "sq8":
        rows = records.select("local_id", "embedding", sq8_scale(F.col("embedding")).alias("scale"))
        return rows.select("local_id", sq8_codes(F.col("embedding"), F.col("scale")).cast("array<tinyint>").alias("codes"), F.col("scale").cast("float").alias("scale"))
    raise ValueError(f"encoding is one of {ENCODINGS}")


def decode(cold: DataFrame, encoding: str) -> DataFrame:
    """local_id and embedding of stored vectors."""
    prepare(cold.sparkSession)
    if encoding == "raw":
        return cold.select("local_id", F.col("vec").alias("embedding"))
    if encoding == "f16":
        def floats(it):
            for b in it:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if v is None else f16_vector(v) for v in b.column(1).to_pylist()], pa.list_(pa.float32()))], ["local_id", "embedding"])

        return cold.select("local_id", "half").mapInArrow(floats, "local_id int, embedding array<float>")
    if encoding == "sq8":
        return cold.select("local_id", sq8_decode(F.col("codes"), F.col("scale")).alias("embedding"))
    raise ValueError(f"encoding is one of {ENCODINGS}")


def write(records: DataFrame, path: str, encoding: str) -> None:
    encode(records, encoding).write.parquet(path)


def read(spark: SparkSession, path: str, encoding: str, ids: DataFrame | None = None) -> DataFrame:
    """local_id and embedding, of the rows in ids (local_id) if given."""
    rows = spark.read.parquet(path)
    if ids is not None:
        rows = rows.join(ids.select("local_id").distinct(), "local_id", "left_semi")
    return decode(rows, encoding)


def bytes_of(n: int, dim: int, encoding: str) -> int:
    """Bytes that reading n vectors takes."""
    return n * (dim * WIDTH[encoding] + (4 if encoding == "sq8" else 0))


