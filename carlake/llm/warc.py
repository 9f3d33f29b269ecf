"""WARC archives of pages, with segmented records and chunked payloads, and their reader.

Writing: a page becomes a response record whose HTTP block carries the payload in chunked transfer framing. Of
equal payloads of MIN_REVISIT bytes or more only the page with the smallest id is a response; the others are
revisit records without a payload. A block above SEGMENT_BYTES is cut into a first record and continuation
records. Spark's text writer writes the archives, gzipped; its line end is the end of a record.

Reading: records are cut out by their Content-Length. Continuations are grouped by origin id, ordered
by segment number, checked for gaps and against the total length, joined, and freed of their chunk framing.

Edge cases: a null html has an empty payload; a null url gives a record without a target; a null page_id is
`null` in the archive and comes back as null, and never is the response that others revisit; repeated rows get
records of their own, and those of the smallest id are all responses; line breaks in a url are
percent-encoded; a damaged record comes back with complete = false and a null payload; an empty table
gives no records.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carlake.llm.common import written
from carlake.session import new_path

MIN_REVISIT = 100
CHUNK_BYTES = 8192
SEGMENT_BYTES = 65536  # longest block of one record
ARCHIVE_RECORDS = 10_000
DATE = "2026-01-01T00:00:00Z"  # no clock is read, so that archives repeat
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 8 << 20

RECORD = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()),
        ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary()),
    ]
)
RECORD_DDL = (
    "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, "
    "refers_to long, segment int, total_length long, block binary"
)


def page_records(pages: DataFrame) -> DataFrame:
    """Pages with payload, payload_bytes, payload_digest, record_type and refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}
    )
    groups = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest")
    first = groups.agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where(F.col("n") > 1)
    # a plain table, so that adaptive execution can split the pages of a hot payload
    first = written(first.select(F.col("payload_digest").alias("digest"), "first_id"), "first_payloads")
    met = rows.join(first, F.col("payload_digest") == F.col("digest"), "left")
    later = F.col("first_id").isNotNull() & F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(True))
    return met.withColumns(
        {
            "record_type": F.when(later, "revisit").otherwise("response"),
            "refers_to": F.when(later, F.col("first_id")),
            "row": F.monotonically_increasing_id(),  # tells records of repeated rows apart
        }
    ).drop("digest", "first_id")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload inside chunked framing; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or body[end + 2 + size : end + 4 + size] not in (b"\r\n", b""):
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def records_of(page: dict, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The WARC records of a page, without the line breaks that end a record."""
    name = f"<urn:page:{page['page_id'] if page['page_id'] is not None else 'null'}:{page['row']}>"
    url, revisit = page["url"], page["record_type"] == "revisit"
    url = url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        block = head + b"Content-Length: %d\r\n\r\n" % page["payload_bytes"]
    else:
        block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(page["payload"])
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    several = len(cuts) > 1
    for k, cut in enumerate(cuts):
        fields: list[tuple[str, object]] = [("WARC-Type", "continuation" if k else page["record_type"])]
        fields += [("WARC-Record-ID", name[:-1] + f":{k + 1}>" if k else name), ("WARC-Date", DATE)]
        if k == 0:
            fields += [
                ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{page['payload_digest']}"),
                ("WARC-Profile", PROFILE if revisit else None), ("Page-Id", page["page_id"]),
                ("Refers-To-Page", page["refers_to"]), ("Content-Type", "application/http; msgtype=response"),
            ]
        else:
            fields += [("WARC-Segment-Origin-ID", name)]
        if several:
            fields += [("WARC-Segment-Number", k + 1)]
            fields += [("WARC-Segment-Total-Length", len(block) if k + 1 == len(cuts) else None)]
        yield _header([*fields, ("Content-Length", len(cut))]) + cut


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Writes a record per page below path, as gzipped archives of at most archive_records records."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for page in _rows(batch):
                for record in records_of(page, segment_bytes):
                    held.append(record)
                    size += len(record)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    records = page_records(pages).mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value"))
    options = {"lineSep": END, "compression": "gzip", "maxRecordsPerFile": archive_records}
    records.write.options(**options).text(path)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one, so that a batch is not held twice."""
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


DAMAGED = (EOFError, OSError, zlib.error)


def parse_archive(content: bytes) -> Iterator[dict]:
    """The records of a gzipped archive, cut out by their Content-Length.

    Where the archive is damaged, the record at hand gets what could be read of it and the rest is given up. A record
    without a sound Content-Length gets an empty block, and reading goes on at the next record."""
    stream = gzip.GzipFile(fileobj=BytesIO(content))
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue  # the line breaks between records
            fields = {"block": b""}
            try:
                while (line := stream.readline()) not in (b"\r\n", b""):
                    key, _, value = line.decode("utf-8", "replace").partition(":")
                    fields[key.strip().lower()] = value.strip()
                fields["block"] = stream.read(max(0, _number(fields.get("content-length")) or 0))
            except DAMAGED:
                yield fields
                return
            yield fields
    except DAMAGED:
        return


def _number(text: str | None) -> int | None:
    """A number as records state it; None where it is damaged."""
    return int(text) if text and re.fullmatch("-?[0-9]{1,18}", text) else None


def _record_row(fields: dict) -> dict:
    number = lambda k: _number(fields.get(k))
    return {
        "record_id": fields.get("warc-segment-origin-id", fields.get("warc-record-id")), "record_type": fields.get("warc-type"),
        "page_id": number("page-id"), "url": fields.get("warc-target-uri"),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, "payload_bytes": None,
        "refers_to": number("refers-to-page"), "segment": number("warc-segment-number"),
        "total_length": number("warc-segment-total-length"), "block": fields["block"],
    }


def parse_records(archives: DataFrame, segmented: bool) -> DataFrame:
    """Records of binary files: the whole ones, or those that are a segment of a longer one."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for fields in parse_archive(content.as_py()):
                    if ("warc-segment-number" in fields) != segmented:
                        continue
                    held.append(_record_row(fields))
                    size += len(fields["block"])
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, RECORD)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, RECORD)

    return archives.select("content").mapInArrow(parse, RECORD_DDL)


def payload_of(block: bytes | None) -> tuple[bytes | None, int | None]:
    """The payload of an HTTP block, and the length that a block without one states."""
    head, found, body = (block or b"").partition(b"\r\n\r\n")
    if not found:
        return None, None
    fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
    if fields.get(b"transfer-encoding") == b"chunked":
        body = unchunked(body)
        return body, None if body is None else len(body)
    return body, _number(fields[b"content-length"].decode("ascii", "replace")) if b"content-length" in fields else len(body)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the segments of a record where they are complete, and takes its payload out."""
    for batch in batches:
        numbers, blocks, lengths = batch.column("segments"), batch.column("blocks"), batch.column("total_length")
        payloads, sizes = [], []
        for i in range(batch.num_rows):
            order, total = numbers[i].as_py(), lengths[i].as_py()
            whole = b"".join(blocks[i].as_py())
            complete = order in ([None], list(range(1, len(order) + 1))) and total in (None if order == [None] else -1, len(whole))
            payload, size = payload_of(whole) if complete else (None, None)
            payloads.append(payload)
            sizes.append(size)
        kept = [n for n in batch.schema.names if n not in ("segments", "blocks", "total_length")]
        arrays = [*(batch.column(n) for n in kept), pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "payload", "stated_bytes"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record_id, record_type, page_id, url, payload_digest, payload_bytes, refers_to, payload, complete.

    A revisit has no payload; its digest and length are those its record states."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    named = ["record_type", "page_id", "url", "payload_digest", "refers_to"]
    whole = parse_records(archives, segmented=False)
    whole = whole.select("record_id", *named, F.array("segment").alias("segments"), F.array("block").alias("blocks"), "total_length")
    parts = parse_records(archives, segmented=True)
    head = [F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in named]
    ordered = F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("ordered")  # of one record, whose payload is one value
    joined = parts.groupBy("record_id").agg(*head, ordered, F.max("total_length").alias("total_length"))
    joined = joined.select(
        "record_id", *named, F.col("ordered.segment").alias("segments"), F.col("ordered.block").alias("blocks"), "total_length"
    )
    kinds = "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to long, payload binary, stated_bytes long"
    decoded = whole.union(joined).mapInArrow(_decode, kinds)
    response = F.col("record_type") == "response"
    digest = F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return decoded.select(
        "record_id", "record_type", "page_id", "url", digest.alias("payload_digest"), F.col("stated_bytes").alias("payload_bytes"),
        "refers_to", F.when(response, F.col("payload")).alias("payload"),
        (F.col("stated_bytes").isNotNull() & digest.eqNullSafe(F.col("payload_digest"))).alias("complete"),
    )


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages to archives below path (else the shared folder) and reads their records back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
