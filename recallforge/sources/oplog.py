"""Operation log: batches of inserts and deletes, each appended as one atomic file set with checksums.

A batch becomes visible when its commit file is created. Its rows are numbered by the tasks that write
them, upwards from the batch's first number, so a large batch needs no single task. Replay keeps the
last operation of each record.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..schema import OPLOG, RECORD
from .files import Files


def checksum():
    fields = [F.col("record")[f.name] if f.name != "metadata" else F.to_json(F.col("record")["metadata"]) for f in RECORD.fields]
    return F.xxhash64("seq", "op", "record_id", *fields).cast("decimal(20,0)")


def inserts(records: DataFrame, first: int) -> DataFrame:
    """Log rows that insert records, numbered from `first` in the order of rows, with gaps between tasks."""
    rows = records.withColumn("__record", F.struct(*[f.name for f in RECORD.fields]))
    return rows.select((F.monotonically_increasing_id() + first).alias("seq"), F.lit("insert").alias("op"), "record_id", F.col("__record").alias("record"))


def deletes(spark: SparkSession, ids: list[int], first: int) -> DataFrame:
    rows = spark.createDataFrame([(first + i, "delete", r) for i, r in enumerate(ids)], "seq long, op string, record_id long")
    return rows.withColumn("record", F.lit(None).cast(RECORD))


def deletes_of(ids: DataFrame, first: int) -> DataFrame:
    """The same for a column record_id."""
    rows = ids.select((F.monotonically_increasing_id() + first).alias("seq"), F.lit("delete").alias("op"), F.col("record_id").cast("long"))
    return rows.withColumn("record", F.lit(None).cast(RECORD))


class OpLog:
    """Numbers have 63 bits. A batch of p tasks takes p * 2 ** 33 of them, so a log holds 2 ** 30 tasks' batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)
        self._sound: set[str] = set()
        self.files.mkdirs(f"{path}/commits")

    def batches(self) -> list[dict]:
        """Committed batches in order; a gap or an unreadable commit is an error."""
        out = []
        for name in self.files.names(f"{self.path}/commits"):
            if not name.endswith(".json"):
                continue
            try:
                out.append(json.loads(self.files.read(f"{self.path}/commits/{name}")))
            except ValueError as e:
                raise ValueError(f"commit {name} of the operation log is torn") from e
        for a, b in zip(out, out[1:]):
            if b["first"] != a["next"]:
                raise ValueError(f"the operation log has a gap before {b['first']}")
        return out

    def next(self) -> int:
        done = self.batches()
        return done[-1]["next"] if done else 0

    def append(self, rows: DataFrame, first: int) -> int:
        """Write rows, then create the commit; a second writer of the same number fails there."""
        data = f"{self.path}/data/{first:020d}"
        rows.withColumn("checksum", checksum()).write.mode("overwrite").parquet(data)
        n, last = self.spark.read.parquet(data).agg(F.count("*"), F.max("seq")).first()
        commit = {"first": first, "next": first if last is None else last + 1, "n": n, "data": data}
        if n:
            self.files.create(f"{self.path}/commits/{first:020d}.json", json.dumps(commit).encode())
        return n

    def rows(self, since: int = 0) -> int:
        """How many rows the commits of the batches from `since` on name."""
        return sum(b["n"] for b in self.batches() if b["next"] > since)

    def read(self, since: int = 0, verify: bool = True) -> DataFrame:
        """Rows numbered `since` on. A batch whose rows are missing or changed is an error; each is looked at once by
        a handle."""
        batches = [b for b in self.batches() if b["next"] > since]
        if not batches:
            return self.spark.createDataFrame([], OPLOG)
        rows = self.spark.read.schema(OPLOG).parquet(*[b["data"] for b in batches])
        new = [b for b in batches if json.dumps(b) not in self._sound]
        if verify and new:
            found = self.spark.read.schema(OPLOG).parquet(*[b["data"] for b in new]).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("checksum") == checksum(), 0).otherwise(1)), F.lit(0)).alias("bad")).first()
            if found.bad or found.n != sum(b["n"] for b in new):
                raise ValueError(f"the operation log is damaged: {found.bad} rows with a wrong checksum, {found.n} rows of {sum(b['n'] for b in new)}")
            self._sound |= set(map(json.dumps, new))
        return rows.where(F.col("seq") >= since)

    def repair(self) -> int:
        """Drop the last commit if it is torn or its data are incomplete; returns how many were dropped."""
        names = [n for n in self.files.names(f"{self.path}/commits") if n.endswith(".json")]
        if not names:
            return 0
        last = f"{self.path}/commits/{names[-1]}"
        try:
            b = json.loads(self.files.read(last))
            if self.spark.read.schema(OPLOG).parquet(b["data"]).count() == b["n"]:
                return 0
        except Exception:  # noqa: BLE001  whatever is wrong with the tail, it goes
            pass
        self.files.delete(last)
        return 1


def latest(log: DataFrame) -> DataFrame:
    """The last operation of each record, by number. A window keeps the one row per record."""
    w = Window.partitionBy("record_id").orderBy(F.desc("seq"))
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def replay(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live records, deleted record ids) that a log leaves."""
    last = latest(log)
    return last.where("op = 'insert'").select("record.*"), last.where("op = 'delete'").select("record_id")
