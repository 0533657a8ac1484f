"""Vector and record files: JSON lines, query files, fvecs/ivecs, matrix files, CSV and summary sinks."""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.filters import RecallQuery
from ..schema import RECORD, checked
from ..session import prepare
from .files import Files

#: Magic of matrix files of vectors and of queries; then version, rows, dimensions and f32 values, all
#: little-endian (a fixed format).
MAGIC = {"vectors": b"HNTR", "queries": b"HNTQ"}
VERSION, OLDEST = 4, 1


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records, one JSON object a line, with segment_id; blank lines are skipped, bad ones fail."""
    from pyspark.sql import types as T

    shape = T.StructType([T.StructField("segment_id", T.LongType()), *RECORD.fields])
    rows = spark.read.schema(shape).option("mode", "FAILFAST").json(path)
    return checked(rows.withColumn("segment_id", F.coalesce("segment_id", F.lit(0))), None, "segment_id")


def read_query(spark: SparkSession, path: str) -> RecallQuery:
    """A query file: one JSON object with any of the query's fields."""
    raw = json.loads(Files(spark).read(path))
    known = set(RecallQuery.__dataclass_fields__)
    if more := set(raw) - known:
        raise ValueError(f"unknown fields: {', '.join(sorted(more))}")
    return RecallQuery(**raw)


def _rows_of_vecs(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.zeros((0, 0))
    dim = struct.unpack_from("<i", data)[0]
    flat = np.frombuffer(data, "<i4").reshape(-1, dim + 1)
    if (flat[:, 0] != dim).any():
        raise ValueError("rows have different dimensions")
    return flat[:, 1:] if kind == "ivecs" else flat[:, 1:].copy().view("<f4")


def _rows_of_matrix(data: bytes, kind: str) -> np.ndarray:
    magic, version, n, dim = struct.unpack_from("<4sIII", data)
    if magic != MAGIC[kind] or not OLDEST <= version <= VERSION or len(data) != 16 + 4 * n * dim:
        raise ValueError(f"not a file of {kind}")
    return np.frombuffer(data, "<f4", offset=16).reshape(n, dim)


def _read(spark: SparkSession, path: str, rows_of, kind: str, id_name: str) -> DataFrame:
    prepare(spark)
    value = "int" if kind == "ivecs" else "float"

    def run(it):
        for b in it:
            for data in b.column(0):
                m = rows_of(data.as_py(), kind)
                for at in range(0, len(m), 8192):
                    part = m[at : at + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.int32() if value == "int" else pa.float32()))], [id_name, "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"{id_name} long, embedding array<{value}>")


def read_vecs(spark: SparkSession, path: str) -> DataFrame:
    """vec_id (row number) and embedding of an .fvecs or .ivecs file."""
    return _read(spark, path, _rows_of_vecs, "ivecs" if path.endswith(".ivecs") else "fvecs", "vec_id")


def read_matrix(spark: SparkSession, path: str, kind: str = "vectors") -> DataFrame:
    """vec_id or query_id (row number) and embedding of a matrix file."""
    return _read(spark, path, _rows_of_matrix, kind, "vec_id" if kind == "vectors" else "query_id")


def matrix_bytes(m: np.ndarray, kind: str = "vectors") -> bytes:
    m = np.asarray(m, "<f4")
    return struct.pack("<4sIII", MAGIC[kind], VERSION, *m.shape) + m.tobytes()


def write_matrix(spark: SparkSession, path: str, m: np.ndarray, kind: str = "vectors") -> None:
    """A matrix the driver holds, as one file."""
    Files(spark).publish(path, matrix_bytes(m, kind))


def write_results(found: DataFrame, path: str) -> None:
    """query_id, rank, vector_id, distance as CSV with a header."""
    found.select("query_id", "rank", F.col("vec_id").alias("vector_id"), "distance").write.option("header", True).csv(path)


def write_summary(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines."""
    metrics.write.json(path)
