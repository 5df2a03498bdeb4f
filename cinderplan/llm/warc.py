"""WARC archives: a writer with payload deduplication and a salvage reader.

Writing: records are rendered with built-in expressions and written by Spark's text sink, whose line separator is the
four bytes that end a record, so that every part file is a WARC file. Of records with equal payloads of at least
``LEAST`` bytes the one with the smallest page_id is a response, the others are revisits that refer to it.

Reading: records are read by their declared lengths. Where a check fails (version line, the grammar of header lines,
the headers that every record has, length, end mark, payload digest, or a damaged gzip member) the reader searches for
the next place that opens a valid record - a version line, or a gzip member that inflates to one - goes on there, and
logs the bytes between as quarantined. A version line is no header line, so that a search ends at the next one and the
work is linear in the bytes.

An archive file is read as one value, so pages are written in ``CLASSES`` by size, with fewer records a file the larger
they are: a file has 128 MB of payload at most, or a single larger record.

Defined results: null html is an empty payload; a null page_id is written as ``none`` and read back as null, a null url
is left out of the header and read back as null; control characters in urls are percent-encoded; rows with equal page_id
and payload are all responses if theirs is the smallest id; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderplan.llm.common import new_folder, small, stored

LEAST = 100
#: (bytes of payload, records in an archive file): up to so many bytes, and so many records at most.
CLASSES = ((1 << 16, 2000), (1 << 20, 128), (1 << 24, 8), (1 << 62, 1))
CRLF = "\r\n"
VERSION = re.compile(rb"WARC/\d\.\d\r\n")
#: How a gzip member begins.
MEMBER = b"\x1f\x8b\x08"
#: Bytes within which a member's header must end and its text begin.
STEP = 4 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def marked(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to): refers_to null for responses.

    Only groups that share a payload are joined back (partial aggregation, one row a digest), so payloads never move.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload)
    d = d.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    shared = d.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    d = d.join(small(stored(shared, "shared")), "digest", "left")
    refers = F.when((F.col("size") >= least) & (F.col("first") < F.coalesce("page_id", F.lit(2**63 - 1))), F.col("first"))
    return d.select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record per row of ``pages(page_id, url, html, ...)`` to WARC files under path."""
    d = marked(pages, least)
    odd = F.col("url").rlike(r"[\x00-\x20\x7F]")
    safe = F.when(odd, F.url_encode("url")).otherwise(F.col("url"))
    lines = lambda *x: F.concat_ws(CRLF, *x)
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.col("size").cast("string"), F.lit(CRLF * 2))
    block = F.when(F.col("refers_to").isNull(), F.concat(http, F.col("payload"))).otherwise(http)
    ident = lambda x: F.concat(F.lit("<urn:page:"), x, F.lit(">"))
    head = lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), ident(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), safe),  # null lines are left out
        F.when(odd, F.lit("X-Target-URI-Encoding: percent")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.concat(F.lit("WARC-Refers-To: "), ident(F.col("refers_to").cast("string"))),
        F.when(F.col("refers_to").isNotNull(), F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    record = F.concat(head, F.lit(CRLF * 2), block)
    kinds = [F.coalesce(F.sum((F.octet_length("html") > a).cast("long")), F.lit(0)) for a in (x[0] for x in CLASSES[:-1])]
    larger = pages.select(F.col("html").cast("string").alias("html")).agg(*kinds).first()  # how many rows are beyond each class
    for k, (most, records) in enumerate(CLASSES):
        if k and not larger[k - 1]:
            break
        some = d.where(F.col("size") <= most) if not k else d.where((F.col("size") > CLASSES[k - 1][0]) & (F.col("size") <= most))
        some.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records).text(f"{path}/{k}")


#: A header line: a token, a colon, and text without control characters.
LINE = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\x00-\x08\x0A-\x1F\x7F]*)\r\n")
#: What every record must say of itself.
NEEDED = {"warc-type", "warc-record-id", "content-length"}


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """The headers of the record at ``at`` and where its block begins; None against the grammar."""
    if not (m := VERSION.match(data, at)):
        return None
    found, at = {}, m.end()
    while data[at : at + 2] != b"\r\n":
        if not (m := LINE.match(data, at)):
            return None
        try:
            found[m[1].decode("ascii").lower()] = m[2].decode("utf-8").rstrip(" \t")
        except UnicodeDecodeError:
            return None
        at = m.end()
    return (found, at + 2) if NEEDED <= found.keys() else None


def _record(data: bytes, at: int, digests: bool = True) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, end) of a sound record at ``at``: its length is there, its end mark follows, its digest holds.

    digests: whether a response or revisit must declare its payload's SHA-256.
    """
    if (head := _headers(data, at)) is None:
        return None
    headers, begin = head
    if not re.fullmatch("[0-9]{1,18}", length := headers["content-length"]) or data[begin + int(length) : begin + int(length) + 4] != b"\r\n\r\n":
        return None
    block = data[begin : begin + int(length)]
    kind, want = headers["warc-type"], headers.get("warc-payload-digest", "")
    if digests and kind in ("response", "revisit") and not re.fullmatch("sha256:[0-9a-f]{64}", want):
        return None
    if kind == "response" and want.startswith("sha256:") and hashlib.sha256(_payload(block)).hexdigest() != want[7:]:
        return None
    return headers, block, begin + int(length) + 4


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def salvage(data: bytes, digests: bool = True) -> Iterator[tuple[str, int, int, dict[str, str] | None, bytes | None]]:
    """("record", start, end, headers, block) for each sound record, ("gap", start, end, None, None) for quarantined bytes.

    digests: as for ``_record``; archives of other writers may have none.
    """
    at, gap = 0, -1
    text = packed = -2  # the next version line and gzip mark: looked for again only when passed
    while at < len(data):
        found = None
        if data[at : at + 3] == MEMBER:
            member = _member(data, at)
            if member and (r := _record(member[0], 0, digests)) and r[2] == len(member[0]):
                found = r[0], r[1], member[1]
        else:
            found = _record(data, at, digests)
        if found:
            if gap >= 0:
                yield "gap", gap, at, None, None
                gap = -1
            yield "record", at, found[2], found[0], found[1]
            at = found[2]
        else:
            gap = at if gap < 0 else gap
            if text <= at:
                text = m.start() if (m := VERSION.search(data, at + 1)) else len(data)
            if packed <= at:
                packed = p if (p := data.find(MEMBER, at + 1)) >= 0 else len(data)
            at = min(text, packed)
    if gap >= 0:
        yield "gap", gap, len(data), None, None


def _member(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The gzip member at ``at``, inflated, and its end; None if damaged, or if nothing comes of its first ``STEP`` bytes."""
    z, out, to, held = zlib.decompressobj(31), [], at, 0
    try:
        while not z.eof and to < len(data):  # in growing steps: what follows the member is not copied again and again
            step = min(64 << 10, max(STEP, to - at))
            out.append(z.decompress(data[to : to + step]))
            held += len(out[-1])
            to = min(len(data), to + step)
            if not held and not z.eof:
                return None  # a header without end
    except zlib.error:
        return None
    return (b"".join(out), to - len(z.unused_data)) if z.eof else None


def _page(ident: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", ident or "")
    return int(m[1]) if m else None


READ = "path string, kind string, start long, end long, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read(spark, path: str, digests: bool = True) -> DataFrame:
    """Every record and quarantined gap (kind "record" or "gap") of the archives under path, with its byte range.

    payload: a response's, null for revisits; payload_bytes and payload_digest: of the full payload, measured on
    responses, as declared on revisits.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for kind, start, end, h, block in salvage(content.as_py(), digests):
                    if kind == "gap":
                        rows.append((name, kind, start, end, *[None] * 7))
                    else:
                        url = h.get("warc-target-uri")
                        url = unquote(url.replace("+", " ")) if url and h.get("x-target-uri-encoding") else url
                        if h.get("warc-type") == "revisit":
                            digest, n = h.get("warc-payload-digest", "").removeprefix("sha256:"), h.get("x-payload-length")
                            rows.append((name, kind, start, end, _page(h.get("warc-record-id")), url, "revisit", None, int(n) if n else None, digest, _page(h.get("warc-refers-to"))))
                        else:
                            p = _payload(block)
                            rows.append((name, kind, start, end, _page(h.get("warc-record-id")), url, h.get("warc-type"), p, len(p), hashlib.sha256(p).hexdigest(), None))
                            held += len(p)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path", "content").mapInArrow(parse, READ)


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and returns what ``read`` recovers from them."""
    path = new_folder(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
