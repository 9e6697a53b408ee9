"""Large array files and JSON documents read in several tasks each, from any file system that Spark reads.

Spark's text source cuts a file into blocks at byte positions and gives records between a one-byte separator, as raw
bytes. Put together again these are the bytes of the file in order, a block after the other, with no limit on the size of
a file (a record, what lies between two separators, must fit in memory). A first pass sums up every block: its length,
and for JSON how quotes and braces in it move the state, for both states it may begin in. The driver carries these along
the blocks of each file, one small row per block. A second pass then knows where its bytes stand: it emits whole array
rows or JSON objects, and the pieces of those that a border cuts, which one small grouping puts together.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyforge.session import bounded_broadcast

PIECE = 4 << 20
HEADER = 1 << 12


def file_blocks(spark: SparkSession, path: str, separator: str, pattern: str | None = None) -> DataFrame:
    """file, size, start (of the block) and data, a record without its separator; rows of a block are in order within one task."""
    reader = spark.read.option("lineSep", separator).option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PIECE))
    meta = F.col("_metadata")
    return reader.text(path).select(meta.file_path.alias("file"), meta.file_size.alias("size"), meta.file_block_start.alias("start"), F.col("value").cast("binary").alias("data"))


def _runs(stream: Iterator[pa.RecordBatch], separator: bytes, extra: tuple[str, ...] = ()) -> Iterator[tuple[tuple, bytes]]:
    """((file, size, start, *extra), bytes with their separators) for the consecutive rows of a block in a batch."""
    for batch in stream:
        if not batch.num_rows:
            continue
        file, start = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("start").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(batch.column(c)[a].as_py() for c in ("file", "size", "start", *extra))
            yield key, b"".join(x for d in batch.column("data").slice(a, b - a).to_pylist() for x in (d, separator))


def _summed(blocks: DataFrame, separator: bytes, fold, schema: str) -> list:
    """One row per block: file, size, start, and what `fold` makes of (state or None, bytes), which ends as a tuple of `schema`."""
    names = [f.name for f in T.StructType.fromDDL(schema)]
    types = {"long": pa.int64(), "string": pa.string()}
    kinds = [types[part.split()[1]] for part in schema.split(", ")]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for key, data in _runs(stream, separator):
            if key != at and at is not None:
                yield told(at, state)
                state = None
            at, state = key, fold(state, data)
        if at is not None:
            yield told(at, state)

    def told(key: tuple, state: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), *(pa.array([v], pa.int64()) for v in key[1:]), *(pa.array([v], k) for v, k in zip(state, kinds))],
                                          ["file", "size", "start", *names])

    return sorted(blocks.mapInArrow(run, f"file string, size long, start long, {schema}").collect())


def _known(blocks: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """`blocks` with what the driver knows about each; rows keep their order, since the small side is broadcast."""
    known = blocks.sparkSession.createDataFrame(rows, f"_file string, _start long, {schema}")
    return blocks.join(bounded_broadcast(known), (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))


# --- array files ----------------------------------------------------------------------

def _header(data: bytes) -> str | None:
    """The shape, type and length of an array file's header as text; None for other files."""
    if data[:6] != b"\x93NUMPY" or len(data) < 12:
        return None
    wide = data[6] >= 2
    begin = 12 if wide else 10
    end = begin + int.from_bytes(data[8:begin], "little")
    told = ast.literal_eval(data[begin:end].decode("latin1"))
    if told["fortran_order"] and len(told["shape"]) > 1:
        raise ValueError("array files in column order can't be read by rows")
    return repr((told["descr"], told["shape"], end))


def npy_rows(spark: SparkSession, path: str, pattern: str | None = "*.npy") -> DataFrame:
    """Array files as rows (file, pos, values): values flattened, as doubles; a file is read by as many tasks as it has blocks."""
    blocks = file_blocks(spark, path, "\n", pattern)

    def measure(state: tuple | None, data: bytes) -> tuple:
        length, head = state or (0, "")
        # A header has some hundred bytes and may hold line ends.
        return length + len(data), head + data[:HEADER - len(head)].decode("latin1")

    found, headers, at = [], {}, {}
    for file, size, start, length, head in _summed(blocks, b"\n", measure, "length long, head string"):
        if file not in headers:
            headers[file] = _header(head.encode("latin1"))
            if headers[file] is None:
                raise ValueError(f"not an array file: {file}")
        found.append((file, start, at.get(file, 0), headers[file]))
        at[file] = at.get(file, 0) + length

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place, rest = None, 0, b""
        for (file, size, start, offset, header), data in _runs(stream, b"\n", ("offset", "header")):
            kind, shape, begin = ast.literal_eval(header)
            wide = int(np.dtype(kind).itemsize * np.prod(shape[1:], dtype=np.int64))
            stop = begin + wide * (shape[0] if shape else 1)
            if (file, start) != at:
                if rest:
                    yield piece(*last, rest)
                at, place, rest = (file, start), offset, b""
            # `place` is where `rest` begins; what lies before the rows, or behind them, is no data.
            data, first = rest + data, place
            lead = max(0, begin - first)
            data, first = data[lead:][:max(0, stop - first - lead)], first + lead
            ahead = -(first - begin) % wide if wide else 0
            if ahead and data:
                yield piece(file, header, first, data[:ahead])
                data, first = data[ahead:], first + min(ahead, len(data))
            whole = len(data) // wide if wide else 0
            if whole:
                values = np.frombuffer(data, np.dtype(kind), whole * wide // np.dtype(kind).itemsize).astype(float)
                yield rows(file, header, (first - begin) // wide, values.reshape(whole, -1))
            rest, place = data[whole * wide:], first + whole * wide
            last = (file, header, place)
        if rest:
            yield piece(*last, rest)

    def piece(file: str, header: str, place: int, data: bytes) -> pa.RecordBatch:
        kind, shape, begin = ast.literal_eval(header)
        wide = int(np.dtype(kind).itemsize * np.prod(shape[1:], dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([(place - begin) // wide], pa.int64()), pa.array([None], pa.list_(pa.float64())),
                                           pa.array([kind]), pa.array([place], pa.int64()), pa.array([data], pa.binary())], names)

    def rows(file: str, header: str, first: int, values: np.ndarray) -> pa.RecordBatch:
        n = len(values)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.arange(first, first + n)), lists, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)

    def mend(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("place")
        data = b"".join(parts.column("data").to_pylist())
        values = np.frombuffer(data, np.dtype(parts.column("kind")[0].as_py())).astype(float)
        return pa.table({"file": [key[0].as_py()], "pos": [key[1].as_py()], "values": [values.tolist()]})

    names = ["file", "pos", "values", "kind", "place", "data"]
    out = _known(blocks, found, "offset long, header string").select("file", "size", "start", "offset", "header", "data").mapInArrow(
        cut, "file string, pos long, values array<double>, kind string, place long, data binary")
    whole = out.where("data IS NULL").select("file", "pos", "values")
    return whole.unionByName(out.where("data IS NOT NULL").groupBy("file", "pos").applyInArrow(mend, "file string, pos long, values array<double>"))


# --- JSON documents -------------------------------------------------------------------

def _braces(data: bytes, quoted: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places of braces outside strings, +1 or -1 for each, whether the data ends within a string)."""
    b = np.frombuffer(data, np.uint8)
    quotes = b == 0x22
    back = b == 0x5C
    if back.any():
        place = np.arange(len(b))
        run = place - np.maximum.accumulate(np.where(back, -1, place))  # length of the run of backslashes up to here
        quotes[1:] &= ~(back[:-1] & (run[:-1] % 2 == 1))
    inside = np.cumsum(quotes) % 2 == (0 if quoted else 1)
    at = np.flatnonzero(((b == 0x7B) | (b == 0x7D)) & ~inside)
    return at, np.where(b[at] == 0x7B, 1, -1), bool(quotes.sum() % 2) != quoted


def json_elements(spark: SparkSession, path: str, level: int = 0, pattern: str | None = None) -> DataFrame:
    """file and text of every object inside `level` others: 0 for the elements of one array or for objects one after the other,
    1 for those in the arrays of one enclosing object."""
    blocks = file_blocks(spark, path, "}", pattern)

    def measure(state: tuple | None, data: bytes) -> tuple:
        # For a start outside and inside a string: depth moved by, least depth on the way; and the parity of quotes.
        moved = state or (0, 0, 0, 0, 0)
        out, flip = [], moved[4]
        for s in (0, 1):
            _, signs, ends = _braces(data, bool(s) != bool(flip))
            depth, low = moved[2 * s], moved[2 * s + 1]
            steps = np.cumsum(signs)
            out += [depth + int(signs.sum()), min(low, depth + int(steps.min())) if len(steps) else low]
            if s == 0:
                after = int(ends)
        return *out, after

    found, at = [], {}
    for file, size, start, d0, low0, d1, low1, flip in _summed(blocks, b"}", measure, "d0 long, low0 long, d1 long, low1 long, flip long"):
        depth, quoted, open_ = at.get(file, (0, 0, -1))
        found.append((file, start, depth, quoted, open_))
        moved, low = (d1, low1) if quoted else (d0, low0)
        closes = depth + low <= level
        at[file] = (depth + moved, quoted ^ flip, (start if closes or depth <= level else open_) if depth + moved > level else -1)

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, depth, quoted, owner, rest = None, 0, False, -1, []
        for (file, size, start, first, begun, open_), data in _runs(stream, b"}", ("depth", "quoted", "owner")):
            if (file, start) != here:
                if rest:
                    yield emit(here, [], [(owner, b"".join(rest))])
                here, depth, quoted, owner, rest = (file, start), first, bool(begun), open_, []
            at, signs, quoted_after = _braces(data, quoted)
            after = depth + np.cumsum(signs)
            opens = at[(signs > 0) & (after == level + 1)].tolist()
            closes = (at[(signs < 0) & (after == level)] + 1).tolist()
            if depth > level:
                opens.insert(0, 0)
            whole, pieces = [], []
            for a, z in zip(opens, closes):
                text = b"".join([*rest, data[a:z]])
                if owner >= 0:
                    pieces.append((owner, text))
                else:
                    whole.append(text)
                rest, owner = [], -1
            if len(opens) > len(closes):
                rest.append(data[opens[-1]:])
            depth, quoted = int(after[-1]) if len(after) else depth, quoted_after
            if whole or pieces:
                yield emit(here, whole, pieces)
        if rest:
            yield emit(here, [], [(owner, b"".join(rest))])

    def emit(here: tuple, whole: list[bytes], pieces: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(whole) + len(pieces)
        owners = [None] * len(whole) + [here[1] if o < 0 else o for o, _ in pieces]
        return pa.RecordBatch.from_arrays([pa.array([here[0]] * n), pa.array([here[1]] * n, pa.int64()), pa.array(owners, pa.int64()), pa.array([*whole, *(t for _, t in pieces)], pa.binary())],
                                          ["file", "start", "owner", "data"])

    out = _known(blocks, found, "depth int, quoted int, owner long").select("file", "size", "start", "depth", "quoted", "owner", "data").mapInArrow(
        cut, "file string, start long, owner long, data binary")
    parts = F.array_sort(F.collect_list(F.struct("start", F.col("data").cast("string").alias("text"))))
    mended = out.where("owner IS NOT NULL").groupBy("file", "owner").agg(F.array_join(F.transform(parts, lambda p: p.text), "").alias("text")).select("file", "text")
    return out.where("owner IS NULL").select("file", F.col("data").cast("string").alias("text")).unionByName(mended)


def read_json_elements(spark: SparkSession, path: str, schema: T.StructType | str, level: int = 0, pattern: str | None = None) -> DataFrame:
    """The objects of `json_elements` with a declared schema, and `_path`."""
    return json_elements(spark, path, level, pattern).select(F.from_json("text", schema).alias("row"), F.col("file").alias("_path")).select("row.*", "_path")
