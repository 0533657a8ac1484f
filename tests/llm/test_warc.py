import base64
import gzip
import hashlib

import pytest
from recallforge.llm import queries, warc


def brute(pages):
    best = {}
    for i, html in pages:
        d = hashlib.sha1((html or "").encode()).digest()
        best[d] = max(best.get(d, (False, 0)), (i is not None, i or 0))
    out = []
    for i, html in pages:
        raw = (html or "").encode()
        d = hashlib.sha1(raw).digest()
        first = best[d] == (i is not None, i or 0)
        out.append((i, len(raw), base64.b32encode(d).decode(), "response" if first else "revisit", None if first else best[d][1]))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pages(spark, data):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    assert rows(queries.op2_warc(spark, data)) == brute(pages)


def test_odd_pages(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    pages = [(1, "u", "x"), (2, "u", "x"), (3, None, None), (4, "u v\r\nX: y", ""), (5, "u", tricky), (6, "é", "é" * 200_000), (7, "u", "x"), (7, "u", "x"), (None, "u", "q"), (None, "u", "x")]
    df = spark.createDataFrame([p + ("n", 1) for p in pages], "page_id long, url string, html string, sha1 string, place int")
    assert rows(warc.captures(spark, warc.write(df))) == brute([(p, h) for p, _, h in pages])
    assert warc.captures(spark, warc.write(df.limit(0))).count() == 0


def test_nested_rows(spark):
    df = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x")], "page_id long, url string, html string")
    records = warc.read(spark, warc.write(df))
    got = {r.metadata[0].page_id: r for r in warc.assemble(records).collect()}
    assert got[2].response.type == "response" and bytes(got[2].response.payload) == b"x"
    assert got[1].response.type == "revisit" and got[1].response.refers_to == got[2].response.record_id
    assert got[1].request.target_uri == "http://a/" and got[1].request.record_id == got[1].response.concurrent_to


def test_concurrent_to_in_the_other_direction(spark):
    shape = warc.SCHEMA
    rows = [("<r>", "response", None, None, "u", None, 1, "D", b"x"), ("<q>", "request", "<r>", None, "u", None, None, None, None), ("<m>", "metadata", "<r>", None, "u", 5, None, None, None), ("<n>", "metadata", "<r>", None, "u", 6, None, None, None), ("<lone>", "response", None, None, "u", None, 1, "D", b"x")]
    got = {r.response.record_id: r for r in warc.assemble(spark.createDataFrame(rows, shape)).collect()}
    assert got["<r>"].request.record_id == "<q>" and [m.page_id for m in got["<r>"].metadata] == [5, 6]
    assert got["<lone>"].request is None and got["<lone>"].metadata == []


def test_parse_of_other_archives():
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [bytes(b) for _, b in warc.parse(warc.inflated(gzip.compress(one) + gzip.compress(one)))] == [b"ab", b"ab"]
    with pytest.raises(ValueError):
        list(warc.parse(one[:-4] + b"c\r\n\r\n"))


def test_archives_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    blocks = [b"x" * n for n in (0, 1, 100, 5000)]
    data = b"".join(b"WARC/1.1\r\nWARC-Type: t\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    for whole in (data, gzip.compress(data), b"".join(gzip.compress(data[i : i + 40]) for i in range(0, len(data), 40))):
        assert [b for _, b in warc.parse(warc.inflated(whole))] == blocks
    with pytest.raises(ValueError):
        list(warc.parse(warc.inflated(gzip.compress(data)[:-9])))


def test_large_payloads_have_files_of_their_own(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "LARGE", 1000)
    pages = [(i, "u", "y" * (5000 if i % 4 == 0 else 10) + str(i % 5)) for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = warc.write(df, f"file://{tmp_path}/out")
    assert rows(warc.captures(spark, path)) == brute([(p, h) for p, _, h in pages])
    assert all(sum("y" * 5000 in b.decode() for _, b in warc.parse(warc.inflated(f.read_bytes()))) <= 1 for f in (tmp_path / "out").glob("part-*"))
