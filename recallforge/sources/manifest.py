"""Snapshots: a manifest names its parent, its branch and its segments; it is published by a rename."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from ..functions.hashing import branch_id, manifest_id
from .files import Files

VERSION = 1


@dataclass
class Sidecar:
    """Binding of an index to one segment; what is None isn't expected."""

    segment_id: int
    kind: str
    required: bool = False
    version: int | None = None
    count: int | None = None
    dim: int | None = None
    fingerprint: str | None = None


@dataclass
class SegmentRef:
    segment_id: int
    path: str
    n: int = 0
    dim: int = 0
    fingerprint: str = ""
    scope_min: int | None = None
    scope_max: int | None = None
    time_min: int | None = None
    time_max: int | None = None
    tier: str = "hot"
    encoding: str | None = None
    cold_path: str | None = None
    sidecar: Sidecar | None = None


@dataclass
class Manifest:
    branch_id: int = 0
    parent_manifest_id: int = 0
    segments: list[SegmentRef] = field(default_factory=list)
    version: int = VERSION
    log_from: int = 0

    @property
    def manifest_id(self) -> int:
        return manifest_id(self.version, self.parent_manifest_id, self.branch_id, [(s.segment_id, s.path) for s in self.segments])

    def checked(self) -> "Manifest":
        ids = [s.segment_id for s in self.segments]
        if len(set(ids)) != len(ids):
            raise ValueError("segment ids repeat")
        if any(not s.path for s in self.segments):
            raise ValueError("a segment has no path")
        if self.version != VERSION:
            raise ValueError(f"manifest version {self.version} isn't known")
        return self

    def fork(self, name: str) -> "Manifest":
        """A child on another branch with the same segments; log and memory tier stay behind."""
        return Manifest(branch_id(name), self.manifest_id, list(self.segments), self.version, self.log_from)

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"manifest_id": str(self.manifest_id), "branch_id": str(self.branch_id), "parent_manifest_id": str(self.parent_manifest_id)}, indent=2)

    @staticmethod
    def from_json(text: str) -> "Manifest":
        raw = json.loads(text)
        claimed = int(raw.pop("manifest_id"))
        segments = [SegmentRef(**{**s, "sidecar": Sidecar(**s["sidecar"]) if s.get("sidecar") else None}) for s in raw.pop("segments")]
        out = Manifest(int(raw["branch_id"]), int(raw["parent_manifest_id"]), segments, raw["version"], raw.get("log_from", 0)).checked()
        if out.manifest_id != claimed:
            raise ValueError("manifest id doesn't fit its content")
        return out

    def write(self, files: Files, path: str) -> int:
        self.checked()
        files.publish(path, self.to_json().encode())
        return self.manifest_id

    @staticmethod
    def read(files: Files, path: str) -> "Manifest":
        return Manifest.from_json(files.read(path).decode())


def sidecar_problem(sidecar: Sidecar, segment: SegmentRef) -> str | None:
    """The first thing that doesn't fit between an index and its segment, or None."""
    for name, mine, theirs in (("segment_id", sidecar.segment_id, segment.segment_id), ("count", sidecar.count, segment.n), ("dim", sidecar.dim, segment.dim), ("fingerprint", sidecar.fingerprint, segment.fingerprint)):
        if mine is not None and mine != theirs:
            return f"{name} is {mine}, the segment has {theirs}"
    if sidecar.version not in (None, VERSION):
        return f"version is {sidecar.version}"
    return None
