"""Token counts of sections by offset-mapped attribution.

A document is encoded once and whole. The lengths of its tokens give their byte spans, the
sections' character offsets are mapped to bytes, and both sorted lists of spans are joined by
search: the tokens that overlap a section are one range. A document's tokens and sections lie in
the same row, so the join needs no shuffle.

A token that crosses a section's border is allocated by rule, and all three are returned:

- `tokens_start`: to the section that holds its first byte;
- `tokens_majority`: to the section that holds most of its bytes, the earlier one on a tie;
- `tokens_fraction`: to each section by its share of the token's bytes.

Where sections cover a text without overlapping, each of the three sums to the tokens of the whole.
Empty sections get no tokens. Offsets beyond the text are cut to it; an end before its start makes
an empty section. Null and empty texts have no tokens, and no line but one of length zero. Ids may
be null or repeated; sections are told apart by number within their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.byte_bpe import RANKS, encoder
from tallyforge.llm.common import arrow_map, extended, query, table

_LENGTHS: dict[str, np.ndarray] = {}
_OUT = "section int, name string, start_char long, end_char long, tokens_start long, tokens_majority long, tokens_fraction double, crossing long"


def token_lengths(ranks_path: str) -> np.ndarray:
    if ranks_path not in _LENGTHS:
        _LENGTHS[ranks_path] = np.array([len(b) for b in encoder(ranks_path)[1]], np.int64)
    return _LENGTHS[ranks_path]


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in characters, of the lines of a text, each with its line feed."""
    ends = np.fromiter((len(x) + 1 for x in text.split("\n")), np.int64)
    ends = np.cumsum(ends)
    ends[-1] -= 1
    return np.concatenate([[0], ends[:-1]]), ends


def byte_offsets(text: str, data: bytes, places: np.ndarray) -> np.ndarray:
    """Byte offsets of character offsets."""
    if len(data) == len(text):
        return places
    firsts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return np.append(firsts, len(data))[places]


def allocate(lengths: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each section by first byte, by majority and by share, and the tokens that cross its borders. All in bytes."""
    n = len(starts)
    if not len(lengths):
        return (np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64))
    stop = np.cumsum(lengths)
    start = stop - lengths
    by_start = np.searchsorted(start, ends, "left") - np.searchsorted(start, starts, "left")
    first = np.searchsorted(stop, starts, "right")  # the range of tokens that overlap a section
    last = np.searchsorted(start, ends, "left")
    some = ends > starts
    by_start = np.where(some, by_start, 0)
    count = np.where(some, last - first, 0)
    head, tail = np.minimum(first, len(lengths) - 1), np.maximum(last - 1, 0)
    before = some & (start[head] < starts)
    after = some & (stop[tail] > ends)
    crossing = before.astype(np.int64) + (after & ~(before & (head == tail)))
    fraction = count.astype(float)
    fraction -= np.where(before, (starts - start[head]) / lengths[head], 0.0)
    fraction -= np.where(after, (stop[tail] - ends) / lengths[tail], 0.0)
    majority = count - crossing
    best: dict[int, tuple[int, int]] = {}
    for k in np.flatnonzero(crossing).tolist():
        for token in {int(t) for t, hit in ((head[k], before[k]), (tail[k], after[k])) if hit}:
            held = int(min(stop[token], ends[k]) - max(start[token], starts[k]))
            best[token] = max(best.get(token, (0, 0)), (held, -k))
    for held, k in best.values():
        if held:
            majority[-k] += 1
    return by_start, majority, fraction, crossing


def attribute(docs: DataFrame, sections: str | None = None, ranks_path: str = RANKS) -> DataFrame:
    """doc_id and one row per section: number, name, character span, and tokens by each rule.

    `sections` names an array<struct<name string, start long, end long>> column of `docs`, in
    characters of `text`; without it the sections are the lines. The array is exploded by the row.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *([F.col(sections).alias("sections")] if sections else []))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = encoder(ranks_path)[0], token_lengths(ranks_path)
        for batch in stream:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                columns: list[list] = [[] for _ in range(8)]
                owner = []
                named = part.column(2).to_pylist() if sections else [None] * part.num_rows
                for row, (text, spans) in enumerate(zip(part.column(1).to_pylist(), named)):
                    names: list = []
                    if sections:
                        spans = [s for s in spans or [] if s is not None]
                        names = [s["name"] for s in spans]
                        starts = np.clip(np.array([s["start"] or 0 for s in spans], np.int64), 0, len(text))
                        ends = np.maximum(starts, np.clip(np.array([len(text) if s["end"] is None else s["end"] for s in spans], np.int64), 0, len(text)))
                    else:
                        starts, ends = line_sections(text)
                    data = text.encode("utf-8", "surrogatepass")
                    ids = encoding.encode_to_numpy(text, disallowed_special=())
                    found = allocate(sizes[ids], byte_offsets(text, data, starts), byte_offsets(text, data, ends))
                    owner.append(np.full(len(starts), row))
                    for column, values in zip(columns, (np.arange(len(starts)), names or [None] * len(starts), starts, ends, *found)):
                        column.append(values)
                rows = np.concatenate(owner)
                flat = [pa.array([n for names in c for n in names], pa.string()) if k == 1 else pa.array(np.concatenate(c)) for k, c in enumerate(columns)]
                flat[0] = flat[0].cast(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *flat], names=["doc_id", *(f.split()[0] for f in _OUT.split(", "))])

    return given.transform(arrow_map, run, extended(given.select("doc_id").schema, _OUT))


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    found = attribute(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "section", "start_char", "end_char", "tokens_start", "tokens_majority", F.round("tokens_fraction", 6).alias("tokens_fraction"), "crossing")
