"""WARC archives as chunked record tables.

An archive is a table of rows ``record, chunk, last, data, digest``: the bytes of a WARC/1.1 file are the ``data`` of
its rows by record and chunk. Chunk 0 starts with the record's headers; a payload longer than ``chunk_bytes`` goes on
in further rows, so neither writer nor reader builds a whole record. ``digest`` is the SHA-256 of the payload up to
the end of the chunk, carried on from chunk to chunk; the last row's is the payload's own. Most records are one row
and are checked where they are read; only records of several chunks are brought together by record, in chunk order,
and hashed as they stream by.

Record identifiers are the writer's own (partition and number), for pages may share theirs; the page's identifier
is a header. Payloads of ``min_revisit`` bytes and more that repeat are written once: the record of the page with the
smallest identifier is the response, the others are revisit records that refer to that page.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafcut.llm.shared import Scratch, text_bytes

CHUNK_BYTES = 1 << 14
CHUNKS = "record string, chunk int, last boolean, data binary, digest binary"
RECORDS = "record string, page long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, intact boolean"
_BATCH = 8 << 20
HOT_SHARE, HOT_ROWS = 0.001, 1000
SALTS = 64
_DATE = "1970-01-01T00:00:00Z"


def plan_records(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 100) -> DataFrame:
    """``id, url, payload, digest, refers_to``: refers_to is null for responses."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_bytes(F.col(payload_col)).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # Only payloads that repeat are looked up.
    firsts = rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = scratch.keep(firsts.select("digest", "first", "n"))
    # Payloads with a share of all repeats (at most 1 / HOT_SHARE have it) and over HOT_ROWS are salted, so that their rows do not meet in one task.
    least = max(HOT_ROWS, HOT_SHARE * (firsts.agg(F.sum("n")).first()[0] or 0))
    hot = F.broadcast(firsts.where(F.col("n") > least).select("digest", F.lit(True).alias("hot")))
    salts = F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    firsts = firsts.select("digest", "first", F.explode(salts).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    found = rows.join(hot, "digest", "left").withColumn("salt", salt).join(firsts, ["digest", "salt"], "left")
    return found.select("id", "url", "payload", "digest", F.when(F.coalesce(F.col("first") != F.col("id"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))


def _head(record: str, page: int | None, url: str | None, size: int, digest: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record}>"), ("WARC-Date", _DATE)]
    if page is not None:
        fields.append(("Page-ID", str(page)))
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    fields += [("WARC-Payload-Digest", f"sha256:{digest.hex()}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(http) + (size if refers_to is None else 0))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def write_chunks(planned: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The archive's chunk rows, one partition of records after another, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("digest", pa.binary())])
        rows, size, n, own = [], 0, 0, TaskContext.get().partitionId()
        for b in batches:
            for k in range(b.num_rows):
                record = f"urn:record:{own}-{n}"
                n += 1
                i, url, payload, digest, refers_to = (b.column(c)[k] for c in range(5))
                i, refers_to, view = i.as_py(), refers_to.as_py(), memoryview(payload.as_buffer())
                head, total = _head(record, i, url.as_py(), len(view), digest.as_py(), refers_to), len(view) if refers_to is None else 0
                running, at, chunk = hashlib.sha256(), 0, 0
                while True:
                    part = view[at : min(at + chunk_bytes, total)]
                    running.update(part)
                    at += len(part)
                    last = at >= total
                    rows.append((record, chunk, last, (head if not chunk else b"") + bytes(part) + (b"\r\n\r\n" if last else b""), running.digest()))
                    size += len(rows[-1][3])
                    if size > _BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows, size = [], 0
                    if last:
                        break
                    chunk += 1
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return planned.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, CHUNKS)


class _Reader:
    """Takes the chunks of a record in order; keeps the headers and a running digest, not the payload."""

    def __init__(self, record: str):
        self.record, self.hash, self.seen, self.next, self.head, self.ok = record, hashlib.sha256(), 0, 0, None, True

    def take(self, chunk: int, last: bool, data: bytes, digest: bytes) -> None:
        self.ok &= chunk == self.next
        self.next += 1
        body = memoryview(data)
        if self.head is None:
            if chunk or not data.startswith(b"WARC/"):
                self.ok = False
                return
            end = data.find(b"\r\n\r\n")
            lines = data[:end].decode().split("\r\n")
            self.head = dict(x.split(": ", 1) for x in lines[1:])
            http = data.find(b"\r\n\r\n", end + 4)
            self.http = dict(x.split(": ", 1) for x in data[end + 4 : http].decode().split("\r\n")[1:])
            self.due = int(self.head["Content-Length"]) - (http + 4 - end - 4)
            self.ok &= lines[0] == "WARC/1.1"
            body = body[http + 4 :]
        if last:
            self.ok &= bytes(body[-4:]) == b"\r\n\r\n"
            body = body[:-4]
        self.hash.update(body)
        self.seen += len(body)
        self.ok &= self.hash.digest() == digest

    def row(self, ended: bool) -> tuple:
        h = self.head
        if h is None:
            return (self.record, None, None, None, None, None, None, False)
        named = h["WARC-Payload-Digest"].removeprefix("sha256:")
        response = h["WARC-Type"] == "response"
        size = int(self.http["Content-Length"])
        ok = self.ok and ended and self.seen == self.due and (self.hash.hexdigest() == named and self.seen == size if response else self.seen == 0)
        page, refers_to = (int(h[k]) if k in h else None for k in ("Page-ID", "Refers-To-Page-ID"))
        ok &= h["WARC-Record-ID"] == f"<{self.record}>"
        return (self.record, page, h["WARC-Type"], refers_to, h.get("WARC-Target-URI"), size, self.hash.hexdigest() if response else named, ok)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record", pa.string()), ("page", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])
    now: _Reader | None = None
    for b in batches:
        rows = []
        for k in range(b.num_rows):
            record, chunk, last, data, digest = (b.column(c)[k].as_py() for c in range(5))
            if now is None or now.record != record or not chunk:
                if now:
                    rows.append(now.row(False))
                now = _Reader(record)
            now.take(chunk, last, data, digest)
            if last:
                rows.append(now.row(True))
                now = None
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
    if now:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, now.row(False), strict=True))], schema)


def read_chunks(chunks: DataFrame) -> DataFrame:
    """A row per record with the outcome of its checks (``intact``).

    ``chunks``: as ``write_chunks`` wrote them, in a table: partition numbers differ where they are made anew. A record
    whose first chunk is missing or has no headers gives a row with nulls that is not intact.
    """
    whole = (F.col("chunk") == 0) & F.col("last")
    single = chunks.where(whole).mapInArrow(_read, RECORDS)
    several = chunks.where(~whole).repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_read, RECORDS)
    return single.union(several)


def archive_bytes(chunks: DataFrame) -> Iterator[bytes]:
    """The archive as a stream of bytes, for a file or a pipe; records in table order by record and chunk."""
    for r in chunks.orderBy("record", "chunk").select("data").toLocalIterator():
        yield bytes(r["data"])


def warc_round_trip(pages: DataFrame, scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 100, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write a record per row of ``pages``, read the archive back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, intact``.

    Null payloads count as empty. Shorter payloads than ``min_revisit`` bytes are all responses. A null url leaves the
    target out; white space and control characters in a url are percent-encoded. Rows whose identifier is null are
    read back with a null one; such a row is a revisit if its payload repeats one with an identifier. Of rows that
    repeat both payload and smallest identifier, each is a response. ``intact``: whether all digests and lengths of the
    record hold. An empty table gives an empty result; other columns are ignored.
    """
    planned = plan_records(pages, scratch, id_col, url_col, payload_col, min_revisit)
    chunks = scratch.keep(write_chunks(planned, chunk_bytes))
    return read_chunks(chunks).select(F.col("page").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
