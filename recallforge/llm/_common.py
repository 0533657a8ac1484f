"""Helpers shared by the corpus operators: table reading, shared scratch tables, worker path.

Scratch tables go to the folder that the cluster names in ``spark.checkpoint.dir``. They cut
lineage the way ``checkpoint()`` does: every executor can read them again after another one is
lost. Tables made inside ``with scratch(spark)`` are deleted at its end; write results before that.
"""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of `[\x20\x09-\x0D]`, the white space of the contracts.
BLANKS = " \t\n\x0b\x0c\r"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Paths made in the innermost `scratch` of this thread or task.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)
_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" and "glibc" in " ".join(os.confstr(n) or "" for n in ("CS_GNU_LIBC_VERSION",) if n in os.confstr_names) else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables; any path that Spark's readers can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch at most; a row that is larger by itself is a batch of its own. Spark's default of
#: 10,000 rows would hold tens of MB of texts a batch outside the heap, in the JVM and in the worker; smaller
#: settings of the session stay.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed on them, in small batches."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, _ROOT])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; in local mode without one, a new folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is there yet."""
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Delete the scratch tables that are made inside, and no others, at the end."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        jvm = spark.sparkContext._jvm
        for name in made:
            path = jvm.org.apache.hadoop.fs.Path(name.rsplit("/", 1)[0])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Give free memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _row_bytes(b: pa.RecordBatch) -> np.ndarray:
    """About how many bytes each row of a batch has in columns of variable length."""
    out = np.full(b.num_rows, 8, np.int64)
    for c in b.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            out += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            out += 8 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
    return out


def slices(batches, rows: int = BATCH_ROWS, most: int = BATCH_BYTES):
    """Arrow batches cut to at most `rows` rows and `most` bytes (or one row), so that a worker holds few texts
    as Python objects.

    After the last one the worker's free memory goes back to the system: workers live on between stages.
    """
    for b in batches:
        upto = np.cumsum(_row_bytes(b))
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right"))
            end = max(at + 1, min(end, at + rows, b.num_rows))
            yield b.slice(at, end - at)
            at = end
    b = None
    trim()
