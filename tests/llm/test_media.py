import hashlib
import struct
import time
import zlib

from recallforge.llm import media, queries
from . import odd


def png(width=1, height=1):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1) * height)) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff!\xf9\x04\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def want(rows):
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        stored = media.store_pcm(payload)
        assert len(payload) % 576 == 0 and len(payload) > 0
        out.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=str)


def test_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = queries.op9_media(spark, data)
    assert got(found) == want(rows)
    said = {}
    for r in found.collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        said[r.doc_id] = declared = media.DECLARED[zlib.crc32(raw + b"\xff" * (r.payload_bytes - len(raw))) % 3]
        assert r.feature == f"audio/wav;declared={declared};audio/wav@0-{r.media_bytes}"  # the texts hold no media
    assert set(said.values()) == set(media.DECLARED)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *a: odd.frame(spark))
    assert got(queries.op9_media(spark, "")) == want([r[:2] for r in odd.ROWS])
    monkeypatch.setattr(queries, "table", lambda *a: odd.frame(spark, []))
    assert got(queries.op9_media(spark, "")) == []


def test_validators_confirm_and_refuse():
    bmp = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x05abc\xff\xda\x00\x02xx\xff\x00yy\xff\xd9"
    whole = {"image/png": png(), "image/gif": GIF, "image/bmp": bmp, "image/jpeg": jpeg, "audio/wav": media.store_pcm(b"abc"), "application/pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"}
    for kind, b in whole.items():
        assert media.parts(b)[0] == (kind, 0, len(b)), kind
        assert media.sniffed(b[:-3]) == media.UNKNOWN, kind
    assert media.sniffed(png()[:40] + b"x" + png()[41:]) == media.UNKNOWN


def test_carving_and_correction(spark):
    inner = b"junk" + png() + b"BMGIF89a more" + GIF
    rows = [(1, inner, "image/jpeg"), (2, media.store_pcm(inner), "audio/wav"), (3, None, None), (4, b"", "image/png"), (5, png(), "image/gif")]
    df = spark.createDataFrame(rows, "doc_id long, media binary, declared string")
    found = {r.doc_id: r for r in media.sniff(df).collect()}
    assert [found[i].type for i in range(1, 6)] == [media.UNKNOWN, "audio/wav", media.UNKNOWN, media.UNKNOWN, "image/png"]
    assert [found[i].corrected for i in (1, 2, 4, 5)] == [True, False, True, True]
    carved = sorted((r.doc_id, r.start, r.type, bytes(r.data)) for r in media.carve(df).collect())
    at = inner.index(GIF)
    assert carved == [(1, 4, "image/png", png()), (1, at, "image/gif", GIF), (2, 48, "image/png", png()), (2, 44 + at, "image/gif", GIF)]
    assert media.read_pcm(media.store_pcm(inner)) == inner


def flac(frames=b"\xff\xf8abc"):
    return b"fLaC" + b"\x00\x00\x00\x22" + b"s" * 34 + b"\x84\x00\x00\x03xyz" + frames


def test_flac_ends_where_the_next_object_starts():
    head = b"fLaC\x80\x00\x00\x22" + b"s" * 34
    assert media.parts(b"xx" + head + b"zz" + png() + b"tail") == [("image/png", 46, 46 + len(png()))]
    whole = b"xx" + flac() + png() + b"tail"
    at = 2 + len(flac())
    assert media.parts(whole) == [("audio/flac", 2, at), ("image/png", at, at + len(png()))]
    assert media.parts(flac()) == [("audio/flac", 0, len(flac()))]


def test_pdf_updates_belong_to_it():
    one = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
    updated = one + b"\n2 0 obj\nstartxref\n40\n%%EOF"
    assert media.parts(b"a" + updated + b"b" + one) == [("application/pdf", 1, 1 + len(updated)), ("application/pdf", 2 + len(updated), 2 + len(updated) + len(one))]


def test_hostile_objects_take_linear_time():
    began = time.time()
    for unit in (b"%PDF-1.4 ", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x05abc\xff\xda\x00\x02xx", b"fLaC\x00\x00\x00\x22" + b"s" * 34, b"GIF89a"):
        assert media.parts(unit * (2_000_000 // len(unit))) == []
    assert time.time() - began < 30
