"""Memory spaces and collections: a manifest's segments, an operation log and the memory tier it makes.

Durability is the log's commit file, visibility follows it at once, and a snapshot is a published
manifest. Files are never changed in place; `collect_garbage` deletes those that no manifest names.
"""

from __future__ import annotations

import json
import os
import socket
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import recall as recalls
from .operators.candidates import CandidateGenerator
from .operators.filters import RecallQuery, matching
from .schema import RECORD, STORED, checked
from .sources import cold, oplog, segments
from .sources.files import Files
from .sources.manifest import Manifest, SegmentRef, sidecar_problem

FLUSH_AT = 5000
#: Segments that a flush writes at the same time.
AT_ONCE = 4


def _abandoned(lock: bytes) -> bool:
    """Whether a lock's writer was a process of this host that isn't there any more."""
    try:
        owner = json.loads(lock)
        if owner["host"] != socket.gethostname():
            return False
        os.kill(int(owner["pid"]), 0)
    except ProcessLookupError:
        return True
    except (ValueError, KeyError, TypeError, PermissionError):
        return False
    return False


class MemorySpace:
    """A handle on one branch. Writers hold the branch's lock from open to close. The lock of a process of this host
    that has died is taken over; take_over does so for one of another host, which only the caller can know is gone."""

    def __init__(self, spark: SparkSession, root: str, manifest_path: str, write: bool = True, flush_at: int = FLUSH_AT, raw_dram_budget: int | None = None, vector_encoding: str | None = None, verify: bool = False, take_over: bool = False):
        self.spark, self.root, self.manifest_path = spark, root.rstrip("/"), manifest_path
        self.files, self.flush_at, self.raw_dram_budget, self.vector_encoding = Files(spark), flush_at, raw_dram_budget, vector_encoding
        self.manifest = Manifest.read(self.files, manifest_path)
        self.notes: list[str] = []
        for s in self.manifest.segments:
            if s.sidecar and (problem := sidecar_problem(s.sidecar, s)):
                if s.sidecar.required:
                    raise ValueError(f"required index of segment {s.segment_id}: {problem}")
                self.notes.append(f"optional index of segment {s.segment_id} ignored: {problem}")
        if verify:
            segments.read(spark, self.manifest.segments, verify=True)
        self.log = oplog.OpLog(spark, f"{self.root}/logs/{self.manifest.branch_id}")
        self._lock = f"{self.log.path}/_lock" if write else None
        if self._lock:
            if self.files.exists(self._lock):
                if not (take_over or _abandoned(self.files.read(self._lock))):
                    raise RuntimeError(f"another writer holds {self._lock}")
                self.notes.append("took over the lock of a writer that is gone")
                self.files.delete(self._lock)
            self.files.create(self._lock, json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "id": uuid.uuid4().hex}).encode())
        self._tier = None
        if raw_dram_budget is not None and write:
            self._enforce_budget()

    def close(self) -> None:
        if self._lock:
            self.files.delete(self._lock)
            self._lock = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    # -- reading ---------------------------------------------------------------------------------

    def memory(self) -> tuple[DataFrame, DataFrame]:
        """(live records, deleted ids) that the log adds to the segments."""
        if self._tier is None:
            self._tier = tuple(oplog.replay(self.log.read(self.manifest.log_from)))
        return self._tier

    def segment_records(self, refs: list[SegmentRef] | None = None, query: RecallQuery | None = None) -> DataFrame:
        """Records of the segments, embeddings of cold ones decoded; column cold says which those are. With a query, of
        cold segments only records that pass its filters, and no other vector of theirs is read to the end."""
        refs = self.manifest.segments if refs is None else refs
        hot = [r for r in refs if r.tier == "hot"]
        parts = [segments.read(self.spark, hot).withColumn("cold", F.lit(False))]
        for r in refs:
            if r.tier != "hot":
                rows = segments.read(self.spark, [r]).drop("embedding")
                rows = rows if query is None else matching(rows, query)
                vectors = cold.read(self.spark, r.cold_path, r.encoding, rows if query is not None else None)
                rows = rows.join(vectors, "local_id")
                parts.append(rows.select(*[f.name for f in STORED.fields]).withColumn("cold", F.lit(True)))
        return reduce(DataFrame.unionAll, parts)

    def pruned(self, query: RecallQuery) -> tuple[list[SegmentRef], dict[int, str]]:
        """Segments to read for a query, and why the others aren't."""
        keep, why = [], {}
        for s in self.manifest.segments:
            if query.scope_id is not None and s.n and not s.scope_min <= query.scope_id <= s.scope_max:
                why[s.segment_id] = "scope_range"
            elif s.n and (query.time_start is not None and s.time_max < query.time_start or query.time_end is not None and s.time_min > query.time_end):
                why[s.segment_id] = "time_range"
            else:
                keep.append(s)
        return keep, why

    def recall(self, query: RecallQuery, generator: CandidateGenerator | None = None, strict_compat: bool = False) -> DataFrame:
        live, gone = self.memory()
        keep, _ = self.pruned(query)
        return recalls.recall(self.segment_records(keep, query), query, generator, live, gone, strict_compat)

    def trace(self, query: RecallQuery, generator: CandidateGenerator | None = None) -> DataFrame:
        from .plans.trace import recall_trace

        keep, why = self.pruned(query)
        return recall_trace(self.segment_records(keep), query, generator, why)

    def get_record(self, record_id: int) -> DataFrame:
        """The live record, or no row."""
        live, gone = self.memory()
        shadow = live.select("record_id").unionAll(gone)
        names = [f.name for f in RECORD.fields]
        stored = self.segment_records().where(F.col("record_id") == record_id).join(shadow, "record_id", "left_anti")
        return live.where(F.col("record_id") == record_id).select(*names).unionAll(stored.select(*names))

    def is_deleted(self, record_id: int) -> bool:
        return bool(self.memory()[1].where(F.col("record_id") == record_id).take(1))

    def resident_raw_dram_bytes(self) -> int:
        """Bytes of embeddings in the memory tier and in hot segments."""
        live = self.memory()[0].agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
        return 4 * live + sum(4 * s.n * s.dim for s in self.manifest.segments if s.tier == "hot")

    # -- writing ---------------------------------------------------------------------------------

    def _append(self, rows_from) -> None:
        if not self._lock:
            raise RuntimeError("the space is open for reading only")
        first = self.log.next()
        self.log.append(rows_from(first), first)
        self._tier = None

    def insert_many(self, records: DataFrame | list[dict]) -> None:
        """Insert or replace records in one atomic batch; flushes when the memory tier is large."""
        if isinstance(records, list):
            records = from_dicts(self.spark, records)
        rows = checked(records)
        dims = {s.dim for s in self.manifest.segments if s.n}
        if len(dims) == 1:
            rows = checked(rows, dims.pop())
        self._append(lambda first: oplog.inserts(rows, first))
        if self.log.rows(self.manifest.log_from) >= self.flush_at and self.memory()[0].count() >= self.flush_at:
            self.flush()
        elif self.raw_dram_budget is not None:
            self._enforce_budget()

    def insert(self, record: dict) -> None:
        self.insert_many([record])

    def delete(self, *record_ids: int) -> None:
        """Delete records, known or not."""
        self._append(lambda first: oplog.deletes(self.spark, list(record_ids), first))

    def delete_many(self, ids: DataFrame) -> None:
        """Delete the records of a column record_id, which stays distributed."""
        self._append(lambda first: oplog.deletes_of(ids, first))

    def _write_segment(self, rows: DataFrame, segment_id: int, encoding: str | None) -> SegmentRef:
        path = f"{self.root}/segments/{segment_id}-{uuid.uuid4().hex}"
        ref = segments.write(rows, path, segment_id)
        return self._cooled(ref, encoding) if encoding else ref

    def _cooled(self, ref: SegmentRef, encoding: str) -> SegmentRef:
        """The segment with its embeddings in a cold file."""
        rows = segments.read(self.spark, [ref])
        path, far = f"{self.root}/segments/{ref.segment_id}-{uuid.uuid4().hex}", f"{self.root}/cold/{ref.segment_id}-{uuid.uuid4().hex}"
        cold.write(rows, far, encoding)
        bare = rows.drop("segment_id").withColumn("embedding", F.lit(None).cast("array<float>"))
        bare.write.parquet(path)
        return replace(ref, path=path, tier="cold", encoding=encoding, cold_path=far)

    def _publish(self, refs: list[SegmentRef], log_from: int, parent: int | None = None) -> None:
        old = self.manifest
        self.manifest = Manifest(old.branch_id, old.manifest_id if parent is None else parent, refs, old.version, log_from)
        self.files.publish(f"{self.root}/manifests/{self.manifest.manifest_id}.json", self.manifest.to_json().encode())
        self.manifest.write(self.files, self.manifest_path)
        self._tier = None

    def flush(self) -> None:
        """Move the memory tier into segments: those with deleted or replaced records are written anew,
        live records become a new one. The manifest is published last."""
        if not self._lock:
            raise RuntimeError("the space is open for reading only")
        upto, (live, gone) = self.log.next(), self.memory()
        live, gone = live.persist(), gone.persist()
        shadow = live.select("record_id").unionAll(gone)
        touched = {r[0] for r in self.segment_records().join(shadow, "record_id", "left_semi").select("segment_id").distinct().collect()}
        n_live = live.count()
        if upto == self.manifest.log_from and not n_live:
            return
        def kept(s: SegmentRef) -> SegmentRef:
            if s.segment_id not in touched:
                return s
            left = self.segment_records([s]).join(shadow, "record_id", "left_anti")
            return self._write_segment(left.select(*[f.name for f in RECORD.fields]), s.segment_id, s.encoding)

        with ThreadPoolExecutor(AT_ONCE) as pool:
            refs = [r for r in pool.map(kept, self.manifest.segments) if r.n]
        if n_live:
            refs.append(self._write_segment(live, max([s.segment_id for s in self.manifest.segments], default=0) + 1, self.vector_encoding))
        self._publish(refs, upto)
        live.unpersist()
        gone.unpersist()
        if self.raw_dram_budget is not None:
            self._enforce_budget()

    def _enforce_budget(self) -> None:
        """Move embeddings of the segments listed first to cold files until the rest fits the budget."""
        over = self.resident_raw_dram_bytes() - self.raw_dram_budget
        refs, changed = [], False
        for s in self.manifest.segments:
            if over > 0 and s.tier == "hot" and s.n:
                over -= 4 * s.n * s.dim
                s, changed = self._cooled(s, self.vector_encoding or "raw"), True
            refs.append(s)
        if changed:
            self._publish(refs, self.manifest.log_from)

    def fork(self, name: str, manifest_path: str) -> Manifest:
        """A branch of the published segments, without log and memory tier."""
        child = self.manifest.fork(name)
        child.log_from = 0
        child.write(self.files, manifest_path)
        self.files.publish(f"{self.root}/manifests/{child.manifest_id}.json", child.to_json().encode())
        return child

    def collect_garbage(self) -> int:
        """Delete segment and cold folders that no manifest of the root names; returns how many."""
        used = set()
        for name in self.files.names(f"{self.root}/manifests"):
            if name.endswith(".json"):
                for s in Manifest.read(self.files, f"{self.root}/manifests/{name}").segments:
                    used |= {s.path, s.cold_path}
        n = 0
        for kind in ("segments", "cold"):
            for name in self.files.names(f"{self.root}/{kind}"):
                if f"{self.root}/{kind}/{name}" not in used:
                    self.files.delete(f"{self.root}/{kind}/{name}")
                    n += 1
        return n


def from_dicts(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Records from dictionaries; vector_id and metadata may be left out, other missing keys fail."""
    out = []
    for r in rows:
        missing = [f.name for f in RECORD.fields if f.name not in r and f.name not in ("vector_id", "metadata")]
        if missing:
            raise ValueError(f"record lacks {', '.join(missing)}")
        if any(isinstance(r[k], int) and r[k] >= 1 << 63 for k in ("record_id", "scope_id")):
            raise ValueError("ids are below 2 ** 63")
        v = {**r, "vector_id": r.get("vector_id"), "metadata": r.get("metadata") or {}}
        out.append(tuple([float(x) for x in v["embedding"]] if f.name == "embedding" else float(v[f.name]) if f.name == "confidence" else v[f.name] for f in RECORD.fields))
    return spark.createDataFrame(out, RECORD)


class Collection:
    """A folder with one space, made empty if it isn't there."""

    def __init__(self, spark: SparkSession, path: str, name: str = "default", **options):
        path, files = path.rstrip("/"), Files(spark)
        at = f"{path}/{name}.manifest.json"
        if not files.exists(at):
            files.mkdirs(path)
            empty = Manifest()
            empty.write(files, at)
            files.publish(f"{path}/manifests/{empty.manifest_id}.json", empty.to_json().encode())
        self.space = MemorySpace(spark, path, at, **options)

    def __getattr__(self, name: str):
        if name in ("insert", "insert_many", "delete", "recall", "flush", "close", "trace", "get_record"):
            return getattr(self.space, name)
        raise AttributeError(name)
