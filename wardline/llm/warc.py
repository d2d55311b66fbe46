"""WARC archives: written with revisits, segments and chunked transfer framing, and read back by reassembly.

Writing. Pages with equal payloads (by SHA-1) of at least ``revisit_bytes`` bytes: that with the smallest id is a response, the
others are revisits that refer to it. A response's block (an HTTP head and the payload in chunks) of more than
``segment_bytes`` is cut: the first record has segment number 1, continuations name its record as their origin, and the last
one gives the total length. Archives are uncompressed and written by Spark to any folder that it can write to,
each of a bounded number of records.

Reading. Records are split by their lengths. Continuations are grouped by origin, ordered by segment number, and
used only if numbers are complete and lengths add up to the total; then the transfer framing is
decoded. A record that fails there, or whose payload does not have the digest it names, is returned with ``intact`` false.

Null html counts as empty. Pages without an id are written with an empty one. Equal payloads of the same smallest id (repeated
rows) are all responses. A page without an id is a response only if no equal one has an id.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import cut_lineage, pieces, prepare, rows_of, text_volume
from wardline.session import checkpoint_dir

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
ARCHIVE_BYTES = 8 << 20

READ = pa.schema([("record", pa.string()), ("kind", pa.string()), ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("url", pa.string()),
                  ("digest", pa.string()), ("refers", pa.string()), ("block", pa.binary())])
READ_DDL = "record string, kind string, segment int, origin string, total bigint, url string, digest string, refers string, block binary"
PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                  ("payload_digest", pa.string()), ("html", pa.string()), ("intact", pa.bool_())])
PAGE_DDL = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, html string, intact boolean"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(kind: str, record: str, length: int, **fields) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in fields.items() if value is not None]
    return ("\r\n".join([*lines, f"Content-Length: {length}"]) + "\r\n\r\n").encode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Transfer framing: length in hex and data, chunk by chunk, and an empty chunk at the end."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at:at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size:end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def _plain(url: str | None) -> str | None:
    """A header value must stay on its line."""
    return None if url is None else "".join("%%%02X" % ord(c) if ord(c) < 33 else c for c in url)


def _records(segment_bytes: int):
    """Records of each page, without the two line ends that follow a record: the text writer adds these."""

    def work(batches):
        for batch in batches:
            out = []
            for page, url, html, first in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")], strict=True):
                payload = (html or "").encode()
                digest = payload_digest(payload)
                name = "" if page is None else page
                record = f"urn:page:{name}/{uuid.uuid4().hex}"
                fields = {"WARC_Target_URI": _plain(url), "WARC_Payload_Digest": f"sha1:{digest}", "Content_Type": "application/http; msgtype=response"}
                if first is not None:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    out.append(_head("revisit", record, len(block), WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                                     WARC_Refers_To=f"<urn:page:{first}>", **fields) + block)
                    continue
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
                cuts = range(0, len(block), segment_bytes)
                for k, at in enumerate(cuts):
                    part = block[at:at + segment_bytes]
                    last = {"WARC_Segment_Total_Length": len(block)} if k and k == len(cuts) - 1 else {}
                    if k == 0:
                        number = {"WARC_Segment_Number": 1} if len(cuts) > 1 else {}
                        out.append(_head("response", record, len(part), **number, **fields) + part)
                    else:
                        out.append(_head("continuation", f"{record}/{k + 1}", len(part), WARC_Segment_Origin_ID=f"<{record}>", WARC_Segment_Number=k + 1, **last) + part)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return work


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 0,
                   segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write ``pages`` to a new folder ``path`` of archives."""
    prepare(pages.sparkSession)
    own = rows_of(pages, page_id=id, url=url, html=html).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    rows, size = text_volume(own, "html")
    own = own.withColumn("digest", F.sha1(F.coalesce("html", F.lit(""))))
    known = cut_lineage(own.select("page_id", "digest", F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")))
    # Copies are grouped with partial sums and met again by a join of two written sides, which Spark can split.
    groups = cut_lineage(known.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1"))
    again = known.join(groups.select("digest", "first"), "digest").where("NOT (page_id <=> first)")
    again = cut_lineage(again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct())
    # One row for an id and payload, whatever number of payloads an id has.
    met = own.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "first")
    out = met.mapInArrow(_records(segment_bytes), "record binary").select(F.col("record").cast("string").alias("value"))
    each = max(1, ARCHIVE_BYTES * max(rows, 1) // max(size + 500 * rows, 1))
    out.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", each).text(path)


def split_records(data: bytes):
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start, length = end + 4, int(headers["content-length"])
        if data[start + length:start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end after {length} bytes")
        yield headers, data[start:start + length]
        at = start + length + 4


def _read(segmented: bool):
    """Records that are segments (first ones and continuations), or those that are not."""

    def work(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for h, block in split_records(data.as_buffer().to_pybytes()):
                    number = h.get("warc-segment-number")
                    if (number is not None) != segmented:
                        continue
                    record, origin = h["warc-record-id"].strip("<>"), h.get("warc-segment-origin-id", "").strip("<>")
                    rows.append((record, h["warc-type"], int(number or 0), origin or record, int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                                 h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h.get("warc-refers-to", "").strip("<>") or None, block))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pydict(dict(zip(READ.names, map(list, zip(*rows, strict=True)), strict=True)), READ)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(READ.names, map(list, zip(*rows, strict=True)), strict=True)), READ)

    return work


def _page_number(record: str | None) -> int | None:
    number = (record or "").removeprefix("urn:page:").split("/")[0]
    return int(number) if number.lstrip("-").isdigit() else None


def _page(record: str, kind: str, url, digest, refers, block: bytes | None) -> tuple:
    """One page from a whole block; None: the segments were not complete."""
    page, first = _page_number(record), _page_number(refers)
    if block is None:
        return page, url, kind, first, None, digest, None, False
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if kind == "revisit":
        return page, url, kind, first, int(fields[b"content-length"]), digest, None, True
    try:
        payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
        return page, url, kind, first, len(payload), payload_digest(payload), payload.decode(), payload_digest(payload) == digest
    except ValueError:
        return page, url, kind, first, None, digest, None, False


def _pages(rows: list[tuple]) -> dict:
    return dict(zip(PAGE.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in PAGE.names}


def _whole(batches):
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(c).to_pylist() for c in ("record", "kind", "url", "digest", "refers", "block")]
            yield pa.RecordBatch.from_pydict(_pages([_page(*row) for row in zip(*columns, strict=True)]), PAGE)


def _reassemble(table: pa.Table) -> pa.Table:
    """One page from its segments, in order of their numbers."""
    rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
    head, last = rows[0], rows[-1]
    complete = [r["segment"] for r in rows] == list(range(1, len(rows) + 1)) and last["total"] == sum(len(r["block"]) for r in rows)
    block = b"".join(r["block"] for r in rows) if complete else None
    kind = head["kind"] if head["kind"] != "continuation" else "response"
    return pa.Table.from_pydict(_pages([_page(head["origin"], kind, head["url"], head["digest"], head["refers"], block)]), PAGE)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, html (null for revisits), intact."""
    prepare(spark)
    # A task holds the archives of one scan partition at most, or one that is larger.
    files = spark.read.format("binaryFile").load(path).select("content")
    whole = files.mapInArrow(_read(False), READ_DDL).mapInArrow(_whole, PAGE_DDL)
    parts = files.mapInArrow(_read(True), READ_DDL).groupBy("origin").applyInArrow(_reassemble, PAGE_DDL)
    return whole.unionByName(parts)


def archive_round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` to archives in a new folder of the shared one, or ``path``, and read them back."""
    spark = pages.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    return read_archives(spark, path)
