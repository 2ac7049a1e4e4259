"""WARC archives: write one transaction per page, read archives back, assemble transactions.

A transaction is a request, a response or revisit, and a metadata record, each
a standard WARC/1.1 record; the first and last name the second in
WARC-Concurrent-To.  Archives are gzip files below a folder of any store that
Spark writes to.  The reader inflates all members of an archive and walks it by
Content-Length, so payloads may hold anything, record separators included.

Defined results: a null html is an empty payload; a null url gives a record
without WARC-Target-URI; a null page_id is kept as null (of equal payloads it
revisits the smallest non-null id; if all ids are null all are responses); rows
that repeat the smallest id are all responses; identical rows each give a
capture; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.llm.common import materialise, tidied

#: Payloads below this size are always stored, never revisited.
MIN_REVISIT_BYTES = 100
#: Mean raw bytes of an archive; readers hold one compressed archive, and one record, in memory.
ARCHIVE_BYTES = 8 << 20

# Fixed values of the format.
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"

RECORD_SCHEMA = "kind string, record_id string, concurrent_to string, refers_to_record string, target_uri string, block_bytes long, payload_bytes long, payload_digest string, payload binary, fields string"


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _record(kind: Column, rid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its final separator; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    return F.concat(
        F.concat_ws(CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}"), *lines,
                    F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))),
        F.lit(CRLF * 2), block,
    )


def plan_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to (null: response), record ids."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")
    ).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    # One narrow row per payload that occurs more than once; the min is combined before the shuffle.
    first = (
        base.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("digest")
        .agg(F.min(F.struct("page_id", "url")).alias("any"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    # A payload that a third of all pages share is one row on the right; adaptive execution splits its pages.
    out = base.join(first, "digest", "left")
    again = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    return out.select(
        "page_id", "url", "payload", "payload_bytes", "digest",
        F.when(again, F.col("first_id")).alias("refers_to"),
        _urn(F.lit("capture"), F.col("page_id"), F.col("url"), F.col("digest")).alias("capture_id"),
        F.when(again, _urn(F.lit("capture"), F.col("first_id"), F.col("first_url"), F.col("digest"))).alias("first_capture"),
    )


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the transactions of pages as gzip archives below path."""
    size = pages.agg(F.avg(F.octet_length(F.col("html").cast("string")))).head()[0] or 0
    plan = plan_captures(pages)
    uri = F.regexp_replace("url", r"[\r\n]", " ")
    cid, revisit = F.col("capture_id"), F.col("refers_to").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    host = F.coalesce(F.regexp_replace(F.regexp_extract(uri, r"^[A-Za-z]+://([^/?#]+)", 1), r"[^!-~]", ""), F.lit(""))
    request = _record(F.lit("request"), _urn(F.lit("request"), cid), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", cid), ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)))
    main = _record(F.when(revisit, "revisit").otherwise("response"), cid,
                   [("WARC-Target-URI", uri), ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Refers-To", F.col("first_capture")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), ("Content-Type", F.lit("application/http; msgtype=response"))],
                   F.concat(head, F.when(revisit, "").otherwise(F.col("payload"))))
    meta = _record(F.lit("metadata"), _urn(F.lit("metadata"), cid), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", cid), ("Content-Type", F.lit("application/json"))],
                   F.to_json(F.struct("page_id", "url", "refers_to")))
    (plan.select(F.concat_ws(CRLF * 2, request, main, meta).alias("value")).write
     .option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(archive_bytes // (size + 1500)))).text(path))


def inflate(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """What a gzip file holds, piece by piece, from all its members: archives often compress each record on its own."""
    at = 0
    while at < len(data):
        member, begin = zlib.decompressobj(31), at
        while not member.eof:
            if at >= len(data):
                raise ValueError(f"the gzip member at byte {begin} breaks off")
            part = data[at:at + step]
            yield member.decompress(part)
            at += len(part) - len(member.unused_data)


def parse(pieces: Iterable[bytes], payloads: bool = True) -> Iterator[tuple]:
    """Records of one archive, given uncompressed in pieces, in RECORD_SCHEMA's order; holds one record and a piece."""
    more, held, at = iter(pieces), bytearray(), 0

    def grow() -> bool:
        nonlocal held, at
        piece = next(more, None)
        if piece is None:
            return False
        del held[:at - begin]
        held += piece
        return True

    begin = 0  # the archive's byte at which held begins
    while True:
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, at - begin + looked - 3))) < 0:
            looked = len(held) - (at - begin)
            had = at
            if not grow():
                if looked:
                    raise ValueError(f"broken WARC record at byte {at}")
                return
            begin = had
        lines = held[at - begin:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        h = dict(x.split(": ", 1) for x in lines[1:])
        size, body = int(h["Content-Length"]), end + 4 - (at - begin)
        while len(held) - (at - begin) < body + size + 4:
            had = at
            if not grow():
                raise ValueError(f"broken WARC record at byte {at}")
            begin = had
        start = at - begin + body
        block = bytes(held[start:start + size])
        if held[start + size:start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"broken WARC record at byte {at}")
        at += body + size + 4
        kind, payload, n, digest = h["WARC-Type"], None, None, None
        if kind in ("response", "revisit"):
            cut = block.index(b"\r\n\r\n") + 4
            if kind == "response":
                payload = block[cut:]
                n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                if h["WARC-Payload-Digest"] != f"sha256:{digest}":
                    raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't match its digest")
            else:
                n = next(int(x[15:]) for x in block[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
        fields = block.decode("utf-8") if kind in ("metadata", "request") else None
        yield (kind, h["WARC-Record-ID"], h.get("WARC-Concurrent-To"), h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), size, n, digest, payload if payloads else None, fields)


#: Records of a batch, and bytes of payload after which one ends.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of all archives below path; payload null unless asked for."""

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

        def out(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

        for batch in batches:
            for content in batch.column("content"):
                some, size = [], 0
                for record in parse(inflate(content.as_py()), payloads):
                    some.append(record)
                    size += len(record[8] or b"")
                    if len(some) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield out(some)
                        some, size = [], 0
                if some:
                    yield out(some)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(rows, RECORD_SCHEMA)


def assemble(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One nested row per capture: record_id, record_type, payload fields, request, metadata.

    Requests and metadata find their capture through WARC-Concurrent-To.
    Captures without either keep null there.  The archives are read once; the
    records go to the shared folder, from where each side is joined.
    """
    records = materialise(read_records(spark, path, payloads), "warc-records")
    main = records.where(F.col("kind").isin("response", "revisit"))
    # Identical rows wrote identical side records: one of each is enough.
    side = {k: records.where((F.col("kind") == k) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("record_id"))
            .agg(F.min(F.struct("record_id", "target_uri", "fields")).alias(k)) for k in ("request", "metadata")}
    meta = F.from_json(F.col("metadata.fields"), "page_id long, url string, refers_to long")
    return main.join(side["request"], "record_id", "left").join(side["metadata"], "record_id", "left").select(
        "record_id", F.col("kind").alias("record_type"), meta["page_id"].alias("page_id"), meta["url"].alias("url"), meta["refers_to"].alias("refers_to"),
        F.struct("payload_bytes", "payload_digest", "payload", "block_bytes", "refers_to_record", "target_uri").alias("response"),
        "request", "metadata",
    )
