import base64
import gzip
import hashlib
import glob

import pytest

from tallyforge.llm import warc
from tallyforge.session import scratch_path

ROWS = [
    (1, "http://a", "x" * 1000), (2, None, None), (3, "u v\r\nw", ""), (4, "http://b", "x" * 1000), (5, "", "é" * 700),
    (6, "http://c", "a\r\n\r\nWARC/1.1\r\nb" * 40), (7, "http://c", "\r\n\r\n" * 100), (8, "http://c", "a\r\n\r\nWARC/1.1\r\nb" * 40),
    (None, "n", "x" * 1000), (9, "d", "one"), (9, "d", "one"), (9, "d", "two" * 300), (9, "d", "two" * 300), (9, "d", "one"), (10, "d", "tail\r\n\r\n"),
]


def plain(rows, least=0):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, d in data:
        if i is not None and len(d) >= least:
            first[d] = min(first.get(d, i), i)
    out = []
    for i, d in data:
        to = first.get(d) if i is not None and first.get(d) != i else None
        out.append((i, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def round_trip(spark, rows, **how):
    df = spark.createDataFrame([(i, u, h.encode() if h is not None else None, 1) for i, u, h in rows], "record_id long, uri string, payload binary, digest int")
    path = scratch_path(spark, "warc")
    warc.write_archives(df, path, **how)
    got = warc.digest_records(warc.read_archives(spark, path)).collect()
    assert all(r.valid for r in got)
    number = lambda x: int(x.split(":")[2]) if x and x.split(":")[2] else None
    return path, sorted(((number(r.record), r.n_bytes, r.digest, r.warc_type, number(r.refers_to)) for r in got), key=str)


@pytest.mark.parametrize("chunk", [7, 64, 65_536])
@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, chunk, least):
    assert round_trip(spark, ROWS, chunk_bytes=chunk, revisit_min_bytes=least)[1] == plain(ROWS, least)


def test_chunks_are_bounded_and_archives_are_warc(spark):
    path, _ = round_trip(spark, ROWS, chunk_bytes=64)
    assert max(len(r.data) for r in warc.read_chunks(warc.read_archives(spark, path)).collect()) <= 64
    raw = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/*.gz"))
    while raw:  # each record is as long as it says
        head, _, rest = raw.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        n = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")).split()[1])
        assert rest[n:n + 4] == b"\r\n\r\n"
        raw = rest[n + 4:]


def test_empty(spark):
    assert round_trip(spark, [])[1] == []
