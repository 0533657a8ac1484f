"""WARC archives and transaction assembly.

`write` archives each page as three records: a request, a response or revisit, and a metadata record
with the page's id; response and metadata name the request in WARC-Concurrent-To. Of pages with equal
payloads the one with the largest page_id is the response and the others are revisits that refer to it.
Spark's own writer puts the records into files, so a lost executor's files are written again as a
whole. Files are gzip streams of WARC/1.1 records.

`read` parses archives record by record, by Content-Length, also uncompressed ones and ones with a
gzip member per record. `assemble` joins request, response and metadata records through their
concurrent-to identifiers, in either direction, and emits one nested row per capture.

Size: `write` shuffles each payload once, by its digest, beside one narrow row per distinct payload; a
payload that a third of all pages share is split by Spark's skew handling. Archives hold at most FILE_CAPTURES captures
of up to LARGE bytes, or one larger capture. A reader holds one archive as it is stored and inflates it record by record.

Defined cases: of equal page_ids with different payloads each is a page of its own; very long payloads are archives of their own; null html is the empty payload, which deduplicates like any other; a null page_id is
smallest and named by no header; rows that repeat page_id and payload of a response are responses
too, with the same record id; a null url leaves out WARC-Target-URI; extra columns aren't read; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._common import materialise, prepare, scratch_path

CRLF = "\r\n"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures in a file at most, and the bytes from which a payload has a file of its own.
FILE_CAPTURES, LARGE = 1000, 1 << 20
#: Bytes that are inflated at once.
CHUNK = 1 << 20
SCHEMA = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, page_id long, payload_bytes long, payload_digest string, payload binary"


def base32(hex160: Column) -> Column:
    """Upper-case base32 of a SHA-1 digest in hex: eight digits for each five bytes."""
    fives = [F.lpad(F.conv(F.substring(hex160, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts) -> Column:
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: Column, record_id: Column, block: Column, mime: Column, uri: Column, *more: tuple[str, Column]) -> Column:
    """The text of a record without its two closing line ends; headers with null values are left out."""
    head = [("WARC-Type: ", kind), ("WARC-Record-ID: ", record_id), ("WARC-Date: ", F.lit(DATE)), ("WARC-Target-URI: ", uri), *more, ("Content-Type: ", mime), ("Content-Length: ", F.octet_length(block).cast("string"))]
    lines = F.concat_ws(CRLF, F.lit("WARC/1.1"), *[F.concat(F.lit(k), v) for k, v in head])
    return F.concat(lines, F.lit(CRLF + CRLF), block)


def write(pages: DataFrame, path: str | None = None) -> str:
    """Archive page_id, url and html of each row; returns the folder of the archives."""
    path = path or scratch_path(pages.sparkSession, "warc")
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("n"))
    first = rows.groupBy("sha1", "n").agg(F.max("page_id").alias("original")).hint("shuffle_hash")
    rows = rows.join(first, ["sha1", "n"])
    revisit = ~F.col("page_id").eqNullSafe(F.col("original"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    place, request = F.monotonically_increasing_id(), F.col("request_id")
    rows = rows.select("*", revisit.alias("revisit"), uri.alias("uri"), place.alias("place")).select("*", _uuid("request", F.col("place"), F.col("page_id"), F.col("sha1")).alias("request_id"))
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    canonical = _uuid("response", F.col("page_id"), F.col("sha1"))
    http = "application/http; msgtype="
    asked = _record(F.lit("request"), request, F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(" HTTP/1.1" + CRLF + CRLF)), F.lit(http + "request"), F.col("uri"))
    got = _record(
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.when(F.col("revisit"), _uuid("revisit", F.col("place"), F.col("page_id"), F.col("sha1"))).otherwise(canonical),
        F.when(F.col("revisit"), head).otherwise(F.concat(head, "html")), F.lit(http + "response"), F.col("uri"),
        ("WARC-Concurrent-To: ", request), ("WARC-Payload-Digest: ", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        ("WARC-Refers-To: ", F.when(F.col("revisit"), _uuid("response", F.col("original"), F.col("sha1")))), ("WARC-Profile: ", F.when(F.col("revisit"), PROFILE)),
    )
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit(""))
    about = _record(F.lit("metadata"), _uuid("metadata", F.col("place"), F.col("page_id"), F.col("sha1")), fields, F.lit("application/warc-fields"), F.col("uri"), ("WARC-Concurrent-To: ", request))
    out = rows.select("n", F.concat_ws(CRLF + CRLF, asked, got, about).alias("value"))
    most = pages.agg(F.max(F.octet_length(html))).first()[0] or 0
    for part, held in ((F.col("n") <= LARGE, FILE_CAPTURES), (F.col("n") > LARGE, 1)) if most > LARGE else ((F.lit(True), FILE_CAPTURES),):
        out.where(part).select("value").write.mode("append").option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", held).text(path)
    return path


def inflated(data: bytes):
    """The bytes of a file, of one or more gzip members or plain, in pieces of about CHUNK."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        while not z.eof:
            piece = z.unconsumed_tail or view[at : at + CHUNK]
            if not len(piece):
                raise ValueError("a gzip member is cut off")
            if not z.unconsumed_tail:
                at += len(piece)
            yield z.decompress(piece, CHUNK)
        at -= len(z.unused_data)


def parse(data):
    """(headers with lower-case names, block) of each record of an archive, given as bytes or as pieces of them."""
    pieces, held, pos, at = iter([data] if isinstance(data, bytes) else data), bytearray(), 0, 0

    def more() -> bool:
        nonlocal pos
        piece = next(pieces, None)
        if piece is not None:
            if pos > CHUNK:  # what has been read goes now and then: each time the rest is moved
                del held[:pos]
                pos = 0
            held.extend(piece)
        return piece is not None

    while True:
        while pos == len(held) and more():
            pass
        if pos == len(held):
            return
        while (end := held.find(b"\r\n\r\n", pos)) < 0 and more():
            pass
        if not held.startswith(b"WARC/", pos) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = held[pos:end].decode("utf-8", "replace").split(CRLF)[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4 - pos
        size = start + int(head["content-length"])
        while len(held) - pos < size + 4 and more():
            pass
        if held[pos + size : pos + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record that ends at byte {at + size} has another length than it says")
        yield head, bytes(held[pos + start : pos + size])
        pos, at = pos + size + 4, at + size + 4


def _fields(head: dict, block: bytes, payloads: bool) -> tuple:
    kind, n, digest, payload, page = head["warc-type"], None, head.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None
    if kind == "response":
        raw = block
        cut = raw.find(b"\r\n\r\n")
        payload = raw[cut + 4 :] if head.get("content-type", "").startswith("application/http") and cut >= 0 else raw
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest not in (None, own):
            raise ValueError(f"payload of {head['warc-record-id']} doesn't have the digest it says")
        n, digest = len(payload), own
    elif kind == "metadata":
        names = dict(x.partition(": ")[::2] for x in block.decode("utf-8", "replace").split(CRLF) if x)
        page = int(names["page-id"]) if "page-id" in names else None
    return head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), page, n, digest, payload if payloads else None


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below path; see SCHEMA. Digests of responses are computed anew."""
    prepare(spark)
    kinds = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def batches(it):
        for b in it:
            for data in b.column(0):
                rows, held = [], 0
                for head, block in parse(inflated(data.as_py())):
                    rows.append(_fields(head, block, payloads))
                    held += len(block)
                    if held > 32_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(batches, SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture (response or revisit): request, response, metadata (an array).

    A request belongs to a capture that names it in concurrent-to or that it names; metadata to the
    request or the response it names. What a capture doesn't have is null, or an empty array.
    """
    part = lambda kind: records.where(F.col("type") == kind)
    whole = F.struct(*records.columns)
    captures = records.where(F.col("type").isin("response", "revisit")).select(F.monotonically_increasing_id().alias("capture"), whole.alias("response"))
    requests = part("request").select(F.struct("record_id", "concurrent_to", "target_uri").alias("request"))
    asked = captures.join(requests, F.col("response.concurrent_to") == F.col("request.record_id"), "left")
    named = part("request").where("concurrent_to is not null").select(F.col("concurrent_to").alias("of"), F.struct("record_id", "concurrent_to", "target_uri").alias("other")).groupBy("of").agg(F.min("other").alias("other"))
    asked = asked.join(named, F.col("response.record_id") == F.col("of"), "left").select("capture", "response", F.coalesce("request", "other").alias("request"))
    about = part("metadata").where("concurrent_to is not null").groupBy("concurrent_to").agg(F.sort_array(F.collect_list(F.struct("record_id", "page_id", "target_uri"))).alias("found"))
    with_request = asked.join(about.select(F.col("concurrent_to").alias("q"), F.col("found").alias("by_request")), F.col("request.record_id") == F.col("q"), "left")
    both = with_request.join(about.select(F.col("concurrent_to").alias("p"), F.col("found").alias("by_response")), F.col("response.record_id") == F.col("p"), "left")
    none = F.array().cast("array<struct<record_id:string,page_id:bigint,target_uri:string>>")
    return both.select("capture", "request", "response", F.concat(F.coalesce("by_request", none), F.coalesce("by_response", none)).alias("metadata"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id) of each capture in the
    archives below path; a revisit's payload is the one of the response it refers to."""
    records = materialise(read(spark, path, payloads=False).drop("payload"), "records")
    found = assemble(records).select(F.get("metadata", F.lit(0))["page_id"].alias("page_id"), "response")
    flat = found.select("page_id", "response.record_id", "response.type", "response.refers_to", "response.payload_bytes", "response.payload_digest")
    flat = materialise(flat, "captures")
    origin = flat.where("type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("origin_page"), F.max("payload_bytes").alias("origin_bytes"), F.max("payload_digest").alias("origin_digest"))
    # Written first, so that the skewed side of the join can be split: one response may have most revisits.
    origin = materialise(origin.withColumnRenamed("record_id", "origin_id"), "origins")
    out = flat.join(origin, flat["refers_to"] == origin["origin_id"], "left")
    return out.select(
        "page_id", F.coalesce("payload_bytes", "origin_bytes").alias("payload_bytes"), F.coalesce("origin_digest", "payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", F.col("origin_page")).alias("refers_to"),
    )
