"""WARC archives written and read as a chunked record table.

The unit that moves is never a record but a chunk of one: a row of record id, chunk number and at
most `chunk_bytes` bytes. The writer turns each chunk into a WARC record of its own: the first is
the response, the others are `continuation` records with segment numbers, as the format provides
for oversized records. The reader splits archives at record starts, so it also yields a row per
chunk, and digests of a record are carried on from chunk to chunk; no task ever holds a record
whole. Archives are written and read by Spark alone, so they may lie in any store it knows.

A record starts after the byte string `SEPARATOR`. Where a payload would make one, the writer cuts
the segment inside it; the reader checks every block against its declared length and digest.

Records with equal payloads of at least `revisit_min_bytes` bytes: the one with the smallest id
is a response, the others are revisits, which carry no payload. Who refers to whom is decided on
(id, digest, length) rows only; a payload that fills a third of the table is one partial minimum
per task.

Null payloads are empty. Records with a null id are responses and are never referred to. Rows
that share an id are told apart by their payload; equal rows are written and returned each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.llm.common import arrow_map, arrow_rows, batches, query, table
from tallyforge.session import scratch_path, settle

CHUNK_BYTES = 65_536
END = b"\r\n\r\n"
START = b"WARC/1.1\r\n"
SEPARATOR = END + START
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: ten hex digits are eight digits to the base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(records: DataFrame, revisit_min_bytes: int = 0) -> DataFrame:
    """`records` (record_id, uri, payload binary) with digest, n_bytes and refers_to (null: a response)."""
    payload = F.coalesce("payload", F.lit(b""))
    records = records.select("record_id", "uri", payload.alias("payload"), base32_sha1(payload).alias("digest"),
                             F.octet_length(payload).cast("long").alias("n_bytes"))
    heads = settle(records.select("record_id", "digest", "n_bytes").where("record_id IS NOT NULL").where(F.col("n_bytes") >= revisit_min_bytes))
    firsts = heads.groupBy("digest", "n_bytes").agg(F.min("record_id").alias("refers_to"), F.max("record_id").alias("last")).where("refers_to <> last")
    again = (heads.join(firsts.drop("last"), ["digest", "n_bytes"]).where("record_id <> refers_to")
             .select(F.col("record_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct())
    return (records.join(again, (F.col("record_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").drop("_id", "_digest"))


def cuts(data: bytes, chunk_bytes: int) -> list[int]:
    """Segment ends: after `chunk_bytes` bytes at most, and never so that a written segment, its line ends included, holds `SEPARATOR`."""
    ends, start = [], 0
    while start < len(data):
        stop = min(start + chunk_bytes, len(data))
        at = (END + data[start:stop] + END).find(SEPARATOR)
        if at >= 0:
            stop = start + at + len(b"WARC")  # between the W of the version and its slash
        ends.append(stop)
        start = stop
    return ends or [0]


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _block(headers: list[tuple[str, object]], block: bytes) -> bytes:
    headers = [*headers, ("WARC-Block-Digest", f"sha1:{_sha1(block)}"), ("Content-Length", len(block))]
    return START + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block


def segments(record_id: int | None, uri: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None,
             chunk_bytes: int, date: str) -> Iterator[bytes]:
    """The WARC records of one row, without the two line ends after each."""
    name = f"urn:page:{'' if record_id is None else record_id}:{digest}"
    target = "".join(c for c in uri or "" if c > " ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    common = [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        yield _block([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *common, ("WARC-Profile", _PROFILE),
                      ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>")], http)
        return
    ends = cuts(payload, chunk_bytes)
    view, total = memoryview(payload), len(http) + n_bytes
    numbered = [("WARC-Segment-Number", 1)] if len(ends) > 1 else []
    yield _block([("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common, *numbered], http + view[:ends[0]])
    for k, (a, b) in enumerate(zip(ends, ends[1:]), 2):
        last = [("WARC-Segment-Total-Length", total)] if k == len(ends) else []
        yield _block([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{k}>"), ("WARC-Date", date), ("WARC-Segment-Number", k),
                      ("WARC-Segment-Origin-ID", f"<{name}>"), *last], bytes(view[a:b]))


def write_archives(records: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, revisit_min_bytes: int = 0,
                   date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes gzip archives to `path`, one per task; `records` needs record_id (long), uri and payload (binary)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s,) for row in arrow_rows(stream) for s in segments(*row, chunk_bytes, date))
        yield from batches(rows, pa.schema([("value", pa.binary())]), weigh=lambda r: len(r[0]))

    ready = with_revisits(records, revisit_min_bytes).select("record_id", "uri", "payload", "digest", "n_bytes", "refers_to")
    ready.transform(arrow_map, run, "value binary").select(F.col("value").cast("string")).write.text(path, compression="gzip", lineSep="\r\n\r\n")


_CHUNKS = ("record string, chunk int, last boolean, warc_type string, uri string, payload_digest string, declared_bytes long, "
           "refers_to string, data binary")


def _parse(raw: bytes) -> tuple:
    raw = raw[len(START):] if raw.startswith(START) else raw
    head, _, rest = raw.partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ": " in line)
    length = int(fields["Content-Length"])
    block = rest[:length]
    if len(block) < length:
        raise ValueError(f"{fields.get('WARC-Record-ID')}: block ends after {len(block)} of {length} bytes; its payload holds a record start")
    if (want := fields.get("WARC-Block-Digest")) and want != f"sha1:{_sha1(block)}":
        raise ValueError(f"{fields.get('WARC-Record-ID')}: block digest differs")
    kind, declared = fields["WARC-Type"], None
    if kind != "continuation":
        http, _, block = block.partition(END)
        declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    bare = lambda name: fields[name].strip("<>") if name in fields else None
    number = int(fields.get("WARC-Segment-Number", 0))
    last = number == 0 or "WARC-Segment-Total-Length" in fields
    return (bare("WARC-Segment-Origin-ID") or bare("WARC-Record-ID"), max(number, 1), last, kind, fields.get("WARC-Target-URI"),
            fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, declared, bare("WARC-Refers-To"), block)


_PARSED = pa.schema([("record", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("warc_type", pa.string()), ("uri", pa.string()),
                     ("payload_digest", pa.string()), ("declared_bytes", pa.int64()), ("refers_to", pa.string()), ("data", pa.binary())])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records and segments of the archives in `path`, one row each: `value`, its bytes, and whether it is one of several `segments`."""
    raw = spark.read.text(path, lineSep=SEPARATOR.decode())
    head = F.substring_index("value", END.decode(), 1)
    return raw.select(F.contains(head, F.lit("WARC-Segment-Number: ")).alias("segments"), F.col("value").cast("binary"))


def read_chunks(archives: DataFrame) -> DataFrame:
    """The chunked record table: one row per record or segment, checked, its part of the payload in `data`."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((_parse(raw) for (raw,) in arrow_rows(stream)), _PARSED, weigh=lambda r: len(r[8]))

    return archives.select("value").transform(arrow_map, run, _CHUNKS)


def _running(chunks: Iterator[tuple]) -> Iterator[tuple]:
    """Digested records out of chunks in order; holds one chunk at a time. A segment that comes twice belongs to equal rows."""
    head = running = before = None
    n = copies = 0
    for row in chunks:
        record, chunk, last, *_, data = row
        if not last and chunk == 1 and (record, chunk) == before:
            copies += 1
            continue
        if chunk == 1:
            head, running, n, copies = row, hashlib.sha1(), 0, 1
        elif (record, chunk) == before:
            continue
        before = (record, chunk)
        running.update(data)
        n += len(data)
        if last:
            _, _, _, kind, uri, digest, declared, refers, _ = head
            size, found = (declared, digest) if kind == "revisit" else (n, base64.b32encode(running.digest()).decode())
            for _ in range(copies):
                yield record, kind, uri, size, found, refers, size == declared and found == digest


def digest_records(archives: DataFrame) -> DataFrame:
    """Per record: record, warc_type, uri, n_bytes and digest of the whole payload, refers_to, valid (they equal what was declared).

    Records of one chunk are digested where they are read; the chunks of others meet in order in
    one task, which carries the running digest on.
    """
    names = ["record", "warc_type", "uri", "n_bytes", "digest", "refers_to", "valid"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    schema, out = pa.schema(list(zip(names, types))), "record string, warc_type string, uri string, n_bytes long, digest string, refers_to string, valid boolean"

    def whole(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(_running(_parse(raw) for (raw,) in arrow_rows(stream)), schema)

    def chunked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(_running(arrow_rows(stream)), schema)

    alone = archives.where("NOT segments").select("value").transform(arrow_map, whole, out)
    tied = read_chunks(archives.where("segments")).repartition("record").sortWithinPartitions("record", "chunk").transform(arrow_map, chunked, out)
    return alone.unionByName(tied)


ORACLE = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda k:
        array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((('0x' || substr(h, (5 * k + 1)::INTEGER, 5))::INTEGER >> s) & 31) + 1, 1)), '')), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op2_warc", ORACLE)
def op2_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload")), path)
    number = lambda c: F.expr(f"try_cast(split({c}, ':')[2] AS bigint)")
    return digest_records(read_archives(spark, path)).select(
        number("record").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))
