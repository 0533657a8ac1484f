"""64-bit FNV-1a, for manifest and branch ids. Numbers use all 64 bits and are stored as DECIMAL(20,0)."""

from __future__ import annotations

#: Offset basis and prime of FNV-1a 64 (fixed values).
BASIS, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1a(data: bytes, state: int = BASIS) -> int:
    for byte in data:
        state = (state ^ byte) * PRIME & MASK
    return state


def branch_id(name: str) -> int:
    return fnv1a(name.encode())


def manifest_id(version: int, parent: int | None, branch: int, segments: list[tuple[int, str]]) -> int:
    """Id of a manifest from its lineage and its segments' ids and paths (with forward slashes). A byte tells whether
    there is a parent; none (or 0) hashes as 0."""
    state = fnv1a(version.to_bytes(4, "little") + bytes([bool(parent)]))
    for number in (parent or 0, branch, len(segments)):
        state = fnv1a(number.to_bytes(8, "little"), state)
    for segment, path in segments:
        state = fnv1a(segment.to_bytes(8, "little"), state)
        state = fnv1a(path.replace("\\", "/").encode() + b"\0", state)
    return state
