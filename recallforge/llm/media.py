"""Media columns: signature sniffing by Aho-Corasick, format validators, type correction, carving.

One automaton finds all known magic bytes in a stored object in one pass. A validator of each format
confirms structure and lengths at every place found, which gives the object's true type (what starts
at its first byte) and embedded media (what starts later) with their exact extents. A declared type
that disagrees is corrected.

A validator reads each byte of an object a bounded number of times: what it must search for (a trailer, an
end marker) is searched once from each place on, and that there is none is remembered for the object.
FLAC says how long its metadata is but not its frames: such an object is taken to reach to the next
confirmed one, or to the end.

`store_pcm` writes a payload as 8-bit mono PCM samples of a RIFF/WAVE file, which is lossless, and
`read_pcm` gives the samples back.

Defined cases: a null object has no type and no parts; an object without a confirmed signature is
application/octet-stream; a part that overlaps the one confirmed before it is not carved; of formats with the same
magic bytes (ties) the first in SIGNATURES that confirms counts; equal objects get equal values; very long objects are
read whole, one at a time; extra columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._common import prepare, slices

RATE = 8000
UNKNOWN = "application/octet-stream"


def _riff(b: bytes, at: int, form: bytes) -> int:
    """End of a RIFF object of that form whose chunks fill it exactly, or 0."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != form:
        return 0
    end, pos = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12
    if end > len(b):
        return 0
    seen = set()
    while pos + 8 <= end:
        seen.add(bytes(b[pos : pos + 4]))
        n = int.from_bytes(b[pos + 4 : pos + 8], "little")
        pos += 8 + n + n % 2
    need = {b"WAVE": {b"fmt ", b"data"}, b"WEBP": set()}[form]
    return end if seen and need <= seen and end <= pos <= end + 1 else 0


def _wav(b: bytes, at: int) -> int:
    return _riff(b, at, b"WAVE")


def _webp(b: bytes, at: int) -> int:
    return _riff(b, at, b"WEBP")


def _png(b: bytes, at: int) -> int:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        n, kind = int.from_bytes(b[pos : pos + 4], "big"), bytes(b[pos + 4 : pos + 8])
        end = pos + 12 + n
        if end > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[pos + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return 0
        if kind == b"IEND":
            return end
        pos, first = end, False
    return 0


def _gif(b: bytes, at: int) -> int:
    def blocks(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        return pos + 1

    if at + 13 > len(b) or not (b[at + 6] | b[at + 7]) or not (b[at + 8] | b[at + 9]):
        return 0
    pos = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            pos += 10 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 128 else 0)
            pos = blocks(pos + 1)
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    pos, frame = at + 2, False
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind, n = b[pos + 1], int.from_bytes(b[pos + 2 : pos + 4], "big")
        if kind in (0x00, 0xFF) or 0xD0 <= kind <= 0xD9 or n < 2:
            return 0
        frame |= kind in (0xC0, 0xC1, 0xC2)
        pos += 2 + n
        if kind == 0xDA:
            if not frame:
                return 0
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b):
                if b[pos + 1] == 0xD9:
                    return pos + 2
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                    continue
                break
            if pos < 0:
                return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 54:
        return 0
    n, reserved, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    fits = reserved == 0 and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height
    rows = (width * bits + 31) // 32 * 4 * abs(height) if fits else 0
    return at + n if fits and 14 + header <= offset and offset + rows <= n and at + n <= len(b) else 0


class _Seen:
    """Places of byte strings in one object; each search goes on where the last one of its kind ended."""

    def __init__(self, b: bytes):
        self.b, self.at = b, {}

    def find(self, what: bytes, start: int) -> int:
        from_, found = self.at.get(what, (0, -2))
        if not from_ <= start or found != -1 and found < start:
            found = self.b.find(what, start)
            self.at[what] = start, found
        return found


def _pdf(b: bytes, at: int, seen: _Seen | None = None) -> int:
    """The end mark of the last section: incremental updates follow the first one without another header."""
    seen = seen or _Seen(b)
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return 0
    other, end, pos = seen.find(b"%PDF-", at + 5), 0, at
    while (start := seen.find(b"startxref", pos)) >= 0 and (other < 0 or start < other):
        if (mark := seen.find(b"%%EOF", start)) < 0 or 0 <= other < mark:
            break
        end = pos = mark + 5
    return end


def _flac(b: bytes, at: int) -> int:
    """End of the metadata blocks, the first of which is a STREAMINFO of 34 bytes, where a frame's sync code follows."""
    pos, last, first = at + 4, False, True
    while not last and pos + 4 <= len(b):
        last, kind, n = bool(b[pos] & 128), b[pos] & 127, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if kind == 127 or first != (kind == 0) or first and n != 34:
            return 0
        pos, first = pos + 4 + n, False
    return pos if last and pos + 2 <= len(b) and b[pos] == 0xFF and b[pos + 1] & 0xFC == 0xF8 else 0


#: Magic bytes, type, validator (end of the object that starts there, or 0).
SIGNATURES = [
    (b"RIFF", "audio/wav", _wav),
    (b"RIFF", "image/webp", _webp),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"fLaC", "audio/flac", _flac),
]


#: Types whose validator gives only the end of what it confirms: the object goes on.
OPEN = {"audio/flac"}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in {s[0] for s in SIGNATURES}:
        found.add_word(magic.decode("latin-1"), (len(magic), [s[1:] for s in SIGNATURES if s[0] == magic]))
    found.make_automaton()
    return found


def parts(media: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of the object itself and of embedded objects, confirmed, by start."""
    out: list[tuple[str, int, int]] = []
    seen = _Seen(media)
    inside = 0  # end of the last embedded part
    for last, (n, formats) in _automaton().iter(media.decode("latin-1")):
        at = last + 1 - n
        if at and at < inside:
            continue
        for kind, ends in formats:
            if kind == "image/jpeg" and seen.find(b"\xff\xd9", at) < 0:
                continue
            if end := ends(media, at, seen) if ends is _pdf else ends(media, at):
                if out and out[-1][0] in OPEN:
                    out[-1] = (*out[-1][:2], at)
                out.append((kind, at, len(media) if kind in OPEN else end))
                inside = end if at or kind in OPEN else 0
                break
    return out


def sniffed(media: bytes) -> str:
    """The object's confirmed type."""
    found = parts(media)
    return found[0][0] if found and found[0][1] == 0 else UNKNOWN


def store_pcm(payload: bytes) -> bytes:
    """A RIFF/WAVE file whose 8-bit mono samples are the payload; an odd length gets the pad byte."""
    n, pad = len(payload), b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + payload + pad


def read_pcm(media: bytes) -> bytes:
    """The samples of a RIFF/WAVE file's data chunk."""
    pos = 12
    while pos + 8 <= len(media):
        n = int.from_bytes(media[pos + 4 : pos + 8], "little")
        if media[pos : pos + 4] == b"data":
            return media[pos + 8 : pos + 8 + n]
        pos += 8 + n + n % 2
    raise ValueError("no data chunk")


def padded(text: str | None, block: int = 576) -> tuple[bytes, int]:
    """The text's UTF-8 with bytes 255 appended up to a positive multiple of block; bytes before that."""
    raw = (text or "").encode()
    return raw + b"\xff" * ((-len(raw)) % block if raw else block), len(raw)


#: Types that `store` declares, right, vague and wrong ones, by the payload's CRC-32.
DECLARED = ("audio/wav", UNKNOWN, "image/png")


def store(docs: DataFrame, block: int = 576) -> DataFrame:
    """doc_id, n_bytes, declared (type), media (stored form of the padded text) of each row."""
    prepare(docs.sparkSession)

    def batches(it):
        for b in slices(it):
            made = [padded(t, block) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([DECLARED[zlib.crc32(p) % 3] for p, _ in made], pa.string()), pa.array([store_pcm(p) for p, _ in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "declared", "media"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(batches, "doc_id long, n_bytes long, declared string, media binary")


def sniff(stored: DataFrame, name: str = "media", declared: str = "declared") -> DataFrame:
    """stored with three more columns: type, corrected (the declared type was another) and parts,
    array<struct<type, start, end>> of all confirmed objects. Columns of these names are replaced."""
    prepare(stored.sparkSession)
    kept = [c for c in stored.columns if c not in ("type", "corrected", "parts")]
    more = T.StructType.fromDDL("type string, corrected boolean, parts array<struct<type:string,start:bigint,end:bigint>>")
    shape = T.StructType([*stored.select(kept).schema.fields, *more.fields])
    spec = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def batches(it):
        for b in slices(it):
            found = [parts(m) if m is not None else [] for m in b.column(kept.index(name)).to_pylist()]
            types = [f[0][0] if f and f[0][1] == 0 else UNKNOWN for f in found]
            said = b.column(kept.index(declared)).to_pylist()
            lists = [[{"type": k, "start": s, "end": e} for k, s, e in f] for f in found]
            more = [pa.array(types, pa.string()), pa.array([t != d for t, d in zip(types, said)], pa.bool_()), pa.array(lists, spec)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*kept, "type", "corrected", "parts"])

    return stored.select(kept).mapInArrow(batches, shape)


def carve(stored: DataFrame, name: str = "media") -> DataFrame:
    """doc_id, type, start, data: one row per embedded object, its bytes cut out."""
    found = sniff(stored, name).select("doc_id", F.explode("parts").alias("p"), F.col(name).alias("__m")).where("p.start > 0")
    return found.select("doc_id", "p.type", "p.start", F.expr("substring(__m, int(p.start) + 1, int(p.end - p.start))").alias("data"))


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    all from the stored bytes, which are read back. The feature is the corrected type, the declared
    type where it was another, and the extents of all parts."""
    prepare(stored.sparkSession)
    shape = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in shape.split(", ")]

    def batches(it):
        for b in slices(it):
            rows = []
            for doc_id, n, declared, media in zip(*(b.column(i).to_pylist() for i in range(4))):
                found = parts(media)
                kind = found[0][0] if found and found[0][1] == 0 else UNKNOWN
                payload = read_pcm(media) if kind == "audio/wav" else media
                feature = f"{kind};declared={declared};" + ",".join(f"{k}@{s}-{e}" for k, s, e in found)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return stored.select("doc_id", "n_bytes", "declared", "media").mapInArrow(batches, shape)
