"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of at most `chunk_chars` code points is one piece. A longer one is cut into chunks, each
carrying `overlap` code points of its successor, and the chunks are pre-tokenised in parallel.
A pre-token boundary that both neighbours found in their common stretch is a place where they
have resynchronised, and the text is cut at the first one; where a stretch holds none (one word
longer than the overlap), the two chunks stay one piece. Pieces are then encoded on their own, and
the ids of a text are those of its pieces in order. Decoding looks up the bytes of each id and
concatenates them, so a character whose bytes fall into two ids is whole again.

Only boundaries between a code point that isn't white space and a space or line feed are offered
for a cut. Every reading of the text has a boundary there, so neighbours can't agree on a wrong
one, and no piece ends in white space, where the pattern's look-ahead would see an end that isn't
there. A text without such places is one piece.

Null texts are empty. Ids may be null or repeated: long texts are followed by the pair of id and
text hash; equal rows are encoded once and returned as often as they came.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from tallyforge.llm.common import arrow_map, arrow_rows, batches, query, table
from tallyforge.session import settle

CHUNK_CHARS = 32_768
OVERLAP = 512
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
_SPLIT = regex.compile(public_tokenizers.PATTERN)
_ENCODERS: dict[str, tuple] = {}
_KEY = ["doc_id", "row"]


def encoder(ranks_path: str = RANKS) -> tuple[tiktoken.Encoding, list[bytes], list[bytes]]:
    """The encoder of a rank file, the bytes of each id and its decimal digits; made once per worker process."""
    if ranks_path not in _ENCODERS:
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        spelled = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            spelled[rank] = token
        encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _ENCODERS[ranks_path] = encoding, spelled, [b"%d" % i for i in range(len(spelled))]
    return _ENCODERS[ranks_path]


def boundaries(text: str, start: int, stop: int) -> list[int]:
    """Pre-token starts of `text` in [start, stop) that may be cut at."""
    return [at for m in _SPLIT.finditer(text)
            if start <= (at := m.start()) < stop and at and text[at] in " \n" and not text[at - 1].isspace()]


def _resynchronised(chunks: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    """doc_id, row, cuts: where neighbouring chunks agree, in order."""

    def edges(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", id_type), ("row", pa.string()), ("k", pa.int64()),
                            ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])

        def found():
            for doc_id, row, k, text in arrow_rows(stream):
                all_of = boundaries(text, 0, chunk_chars + overlap)
                origin = k * chunk_chars
                yield (doc_id, row, k, [origin + b for b in all_of if b < overlap],
                       [origin + b for b in all_of if b >= chunk_chars])

        yield from batches(found(), schema)

    id_type = pa.int64() if chunks.schema["doc_id"].dataType.typeName() == "long" else pa.string()
    kind = chunks.schema["doc_id"].dataType.simpleString()
    order = Window.partitionBy(*_KEY).orderBy("k")
    return (chunks.repartition(*_KEY, "k").transform(arrow_map, edges, f"doc_id {kind}, row string, k long, head array<long>, tail array<long>")
            .withColumn("cut", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
            .groupBy(*_KEY).agg(F.array_sort(F.collect_list("cut")).alias("cuts")))


def pieces(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk, and the pieces of longer ones: doc_id, row (null for the former), copies, piece, n_pieces and text."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.char_length(text).alias("n"))
    short = base.where(F.col("n") <= chunk_chars).select(
        "doc_id", F.lit(None).cast("string").alias("row"), F.lit(1).cast("long").alias("copies"),
        F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), "text")
    long = settle(base.where(F.col("n") > chunk_chars).withColumn("row", F.sha2("text", 256)).groupBy(*_KEY)
                  .agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"), F.first("n").alias("n")))
    chunks = (long.select(*_KEY, "text", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk_chars))).alias("k"))
              .select(*_KEY, "k", F.substring("text", (F.col("k") * chunk_chars + 1).cast("int"), F.lit(chunk_chars + overlap)).alias("text")))
    cuts = _resynchronised(chunks, chunk_chars, overlap)
    same = F.col("l.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("l.row") == F.col("c.row"))
    marks = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts"), F.array(F.col("n").cast("long")))
    cut = (long.alias("l").join(cuts.alias("c"), same)
           .select("l.doc_id", "l.row", "copies", "text", marks.alias("marks"))
           .select(*_KEY, "copies", "text", "marks", F.explode(F.sequence(F.lit(0), F.size("marks") - 2)).alias("piece"))
           .select(*_KEY, "copies", "piece", (F.size("marks") - 1).alias("n_pieces"),
                   F.substring("text", (F.get("marks", "piece") + 1).cast("int"), (F.get("marks", F.col("piece") + 1) - F.get("marks", "piece")).cast("int")).alias("text")))
    return short, cut.repartition(*_KEY, "piece")


def _with_ids(batch: pa.RecordBatch, ids: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*batch.schema.names[:-1], "ids"])


def encode_pieces(parts: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """`parts` with `ids` in place of their text."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks_path)[0]
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield _with_ids(part, [encoding.encode_to_numpy(t, disallowed_special=()) for t in part.column(5).to_pylist()])

    kind = parts.schema["doc_id"].dataType.simpleString()
    return parts.transform(arrow_map, run, f"doc_id {kind}, row string, copies long, piece int, n_pieces int, ids array<int>")


def encode(docs: DataFrame, ranks_path: str = RANKS, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: doc_id, row, copies, piece, n_pieces, ids. `docs` needs doc_id and text; other columns stay behind."""
    short, cut = pieces(docs, chunk_chars, overlap)
    return encode_pieces(short, ranks_path).unionByName(encode_pieces(cut, ranks_path))


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    offsets, values = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)
    for a, b in zip(offsets, offsets[1:]):
        yield values[a:b].tolist()


def decode(encoded: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """The pieces of `encoded` with their raw bytes in `data` in place of `ids`; in order of piece they make up the text."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = encoder(ranks_path)[1]
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                data = pa.array([b"".join(map(spelled.__getitem__, ids)) for ids in _lists(part.column(5))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], data], names=[*part.schema.names[:-1], "data"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.transform(arrow_map, run, f"doc_id {kind}, row string, copies long, piece int, n_pieces int, data binary")


def digests(docs: DataFrame, ranks_path: str = RANKS, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Encodes and decodes `docs`; per text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A text of one piece is hashed where it lies. The pieces of a longer one meet in order in one
    task, which holds a piece at a time and carries the two running hashes on.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, spelled, digits = encoder(ranks_path)

        def texts():
            n, of_ids, of_bytes, done = 0, hashlib.sha256(), hashlib.sha256(), None
            for batch in stream:
                plain = [batch.column(i).to_pylist() for i in range(5)]
                for doc_id, row, copies, piece, n_pieces, ids in zip(*plain, _lists(batch.column(5))):
                    if piece == 0:
                        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                    if n and ids:
                        of_ids.update(b" ")
                    of_ids.update(b" ".join(map(digits.__getitem__, ids)))
                    of_bytes.update(b"".join(map(spelled.__getitem__, ids)))
                    n += len(ids)
                    if piece == n_pieces - 1:
                        for _ in range(copies):
                            yield doc_id, n, of_ids.hexdigest(), of_bytes.hexdigest()

        id_type = pa.int64() if kind == "bigint" else pa.string()
        yield from batches(texts(), pa.schema([("doc_id", id_type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                                               ("decoded_sha256", pa.string())]))

    short, cut = pieces(docs, chunk_chars, overlap)
    kind = short.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    alone = encode_pieces(short, ranks_path).transform(arrow_map, run, out)
    tied = encode_pieces(cut, ranks_path).repartition(*_KEY).sortWithinPartitions(*_KEY, "piece").transform(arrow_map, run, out)
    return alone.unionByName(tied)


@query("op4_byte_bpe")
def op4_byte_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
