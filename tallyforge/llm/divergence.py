"""Source divergence audit: token-start pointers sorted by multikey quicksort, equal runs as term counts.

A task looks at the bytes of a slice of Arrow text buffers. A term is a run of letters or of bytes above
127; the starts of all terms are pointers into the buffer, and no term is copied. Per language (a shard of
the slice) the pointers are sorted by multikey quicksort: three-way partitions by eight bytes at a time,
small parts by a plain sort of twenty-four. Equal pointers then stand together; a run gives one row: the
term, in how many documents of the slice it stands, and its count per source. So what leaves a task is a
row per term and slice of SLICE_BYTES, not a row per word.

The runs are written once. A term is kept if its document frequencies add up to `min_docs` in its
language; only kept terms are counted by source, and only they are joined, by their key. Every group's
share is smoothed over the kept terms in whole numbers (decimals where 64 bits could overflow).

Shares of two sources are compared in blocks: a block of terms by two blocks of sources makes one dense
table of a bounded size in one task, and distances are summed over the blocks of terms. There is one row
per pair of sources and block, never one per pair and term. Terms above their language's share are cut to
the first `top` per group before they move.

Null text, lang and source read as ''. Rows are documents: repeated rows count each. Groups without terms
stand with counts of zero, a language without kept terms has distances of 0, an empty table gives no rows.
Equal values are ordered by the item's bytes. Only text, lang and source are read, so other columns may
have any name. One text is sorted in one task, whose memory is a small multiple of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyforge.llm.common import arrow_map, query, table
from tallyforge.session import bounded_broadcast, settle

SLICE_BYTES = 8 << 20
# Parts of at most so many pointers are sorted plainly.
SMALL = 2048
TERMS_A_BLOCK, SOURCES_A_BLOCK = 256, 256

_CODES = np.arange(256, dtype=np.uint8)
_IS_TERM = (_CODES > 0x7F) | ((_CODES >= 0x41) & (_CODES <= 0x5A)) | ((_CODES >= 0x61) & (_CODES <= 0x7A))
_LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)
# The first k of eight bytes.
_FIRST = np.array([0] + [(2 ** 64 - 1) ^ (2 ** (64 - 8 * k) - 1) for k in range(1, 9)], dtype=np.uint64)
_WORD = 8


class Pointers:
    """Starts and lengths of the terms of some texts, as places in one buffer of bytes."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets -= offsets[0]
        self.data = np.concatenate([_LOWER[data], np.zeros(_WORD, np.uint8)])
        inside = _IS_TERM[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a term ends where its text does
        follows = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        self.starts = np.flatnonzero(inside & (~follows | edge[:-1]))
        ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if len(data) else self.starts
        self.lengths = ends - self.starts
        self.texts = np.searchsorted(offsets, self.starts, side="right") - 1
        # Eight bytes from any place, the first one leading.
        self.words = np.ndarray((len(data) + 1,), ">u8", self.data.tobytes(), strides=(1,))

    def key(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The eight bytes of the terms `at` from `depth` on, zeros after their ends; no term holds a zero byte."""
        rest = np.clip(self.lengths[at] - depth, 0, _WORD)
        return self.words[np.minimum(self.starts[at] + depth, len(self.words) - 1)].astype(np.uint64) & _FIRST[rest]

    def text_of(self, at: np.ndarray) -> pa.Array:
        """The terms `at` as an Arrow array."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - ends + lengths, lengths)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(self.data[place].tobytes()))


def equal_runs(pointers: Pointers, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): pointers sorted by shard and term, stable, and True where a new shard or term begins."""
    order = np.argsort(shard, kind="stable")
    first = np.zeros(len(order), bool)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]])
    slices = [(int(a), int(b), 0) for a, b in zip(bounds, bounds[1:]) if b > a]
    while slices:
        low, high, depth = slices.pop()
        part = order[low:high]
        key = pointers.key(part, depth)
        if high - low > SMALL:
            pivot = np.partition(key[:: (high - low) // 63], 32)[32]
            less, more = key < pivot, key > pivot
            same = ~(less | more)
            a, b = low + int(less.sum()), high - int(more.sum())
            order[low:high] = np.concatenate([part[less], part[same], part[more]])
            slices += [s for s in ((low, a, depth), (b, high, depth)) if s[1] > s[0]]
            if int(pivot) & 0xFF:
                slices.append((a, b, depth + _WORD))
            else:
                first[a] = True  # the terms end within these bytes: all equal
            continue
        later = [pointers.key(part, depth + _WORD * k) for k in (1, 2)]
        by = np.lexsort((later[1], later[0], key))
        order[low:high] = part[by]
        key, later = key[by], [k[by] for k in later]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (later[0][1:] != later[0][:-1]) | (later[1][1:] != later[1][:-1])])
        first[low:high] = new
        runs = np.append(np.flatnonzero(new), high - low)
        longer = np.flatnonzero((later[1][runs[:-1]] & np.uint64(0xFF) != 0) & (np.diff(runs) > 1))
        slices += [(low + int(runs[i]), low + int(runs[i + 1]), depth + 3 * _WORD) for i in longer]
    return order, first


def _slice_runs(batch: pa.Table) -> Iterator[pa.RecordBatch]:
    """One row per language and term of a slice."""
    pointers = Pointers(batch.column("text").combine_chunks())
    if not len(pointers.starts):
        return
    langs, sources = (batch.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    lang_of, source_of = (np.asarray(x.indices).astype(np.int64) for x in (langs, sources))
    order, first = equal_runs(pointers, lang_of[pointers.texts])
    text = pointers.texts[order]
    run = np.cumsum(first) - 1
    # The sort is stable, so the places of one text stand together within a run.
    new_text = first | np.concatenate([[True], text[1:] != text[:-1]])
    heads = np.flatnonzero(first)
    frequency = np.add.reduceat(new_text.astype(np.int64), heads)
    cell, count = np.unique(run * len(sources.dictionary) + source_of[text], return_counts=True)
    cell_run = cell // len(sources.dictionary)
    offsets = pa.array(np.searchsorted(cell_run, np.arange(len(heads) + 1)).astype(np.int32))
    columns = [
        langs.dictionary.take(pa.array(lang_of[text[heads]])), pointers.text_of(order[heads]), pa.array(frequency),
        pa.ListArray.from_arrays(offsets, sources.dictionary.take(pa.array(cell % len(sources.dictionary)))),
        pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int64)))]
    whole = pa.Table.from_arrays(columns, ["lang", "term", "df", "sources", "counts"])
    yield from whole.to_batches(max_chunksize=50_000)


def term_runs(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, term, df (documents of a slice that hold it), sources and counts, one row per term and slice."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in stream:
            held.append(batch)
            if sum(b.nbytes for b in held) >= slice_bytes:
                yield from _slice_runs(pa.Table.from_batches(held))
                held = []
        if held:
            yield from _slice_runs(pa.Table.from_batches(held))

    return arrow_map(docs.select("text", "lang", "source"), run, "lang string, term string, df long, sources array<string>, counts array<long>")


def _share(count: str, total: str, terms: str) -> str:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)) in decimals wide enough for any 64-bit count."""
    return f"CAST(1 + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({count} + 5 AS DECIMAL(19, 0))) div ({total} + 5 * {terms}) AS BIGINT)"


def _block_distances(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Distances of a block's pairs of sources over a block of terms, less what they would be with counts of zero.

    A source has one row without a term, which carries its share for a count of zero.
    """
    lang, tb, a, b = (k.as_py() for k in key)
    names, row = np.unique(np.asarray(rows.column("source").to_pylist(), dtype=object), return_inverse=True)
    share, block = np.asarray(rows.column("p")), np.zeros(len(names), np.int64)
    block[row] = np.asarray(rows.column("sb"))
    terms = rows.column("term").combine_chunks().dictionary_encode()
    col = np.asarray(terms.indices.fill_null(-1))
    zero = np.zeros(len(names), np.int64)
    zero[row[col < 0]] = share[col < 0]
    kept = np.asarray(rows.column("v").combine_chunks())[0]
    dense = np.repeat(zero[:, None], max(1, len(terms.dictionary)), axis=1)
    dense[row[col >= 0], col[col >= 0]] = share[col >= 0]
    left, right, value = [], [], []
    for i in range(len(names)):
        # Within one block each pair once; across two, those of one with those of the other.
        others = np.arange(i + 1, len(names)) if a == b else np.flatnonzero(block == b) if block[i] == a else np.arange(0)
        base = np.abs(zero[others] - zero[i])
        found = np.abs(dense[others] - dense[i]).sum(axis=1) - base * dense.shape[1] + (base * kept if tb == 0 else 0)
        left += [names[i]] * len(others)
        right += [names[k] for k in others]
        value += found.tolist()
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "x": pa.array(left, pa.string()), "y": pa.array(right, pa.string()),
                     "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, slice_bytes: int = SLICE_BYTES,
               terms_a_block: int = TERMS_A_BLOCK, sources_a_block: int = SOURCES_A_BLOCK) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank, as the module says."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    runs = settle(term_runs(docs, slice_bytes), "zstd")
    kept = bounded_broadcast(runs.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= min_docs).select("lang", "term"))
    cells = runs.join(kept, ["lang", "term"]).select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    counts = settle(cells.groupBy("lang", F.col("c.sources").alias("source"), "term").agg(F.sum("c.counts").alias("n")))

    by_lang = counts.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("nl"))
    by_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("ng"))
    sizes = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left").na.fill(0)
    per_lang = Window.partitionBy("lang")
    groups = bounded_broadcast(sizes.select(
        "lang", "source", "v", "ng", "nl", F.expr(f"CASE WHEN v = 0 THEN 0 ELSE {_share('0', 'ng', 'v')} END").alias("p0"),
        F.ceil(F.count("one").over(per_lang) / sources_a_block).cast("int").alias("sbs"),
        F.greatest(F.lit(1), F.ceil(F.col("v") / terms_a_block).cast("int")).alias("tbs")))
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("n", "ng", "v")))

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("nt"))
    above = shares.join(whole, ["lang", "term"]).withColumn("value", F.col("p") - F.expr(_share("nt", "nl", "v"))).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))

    source_block = F.pmod(F.xxhash64("source"), F.col("sbs")).cast("int").alias("sb")
    dense = shares.select("lang", "source", "term", "p", "v", "sbs", source_block, F.pmod(F.xxhash64("term"), F.col("tbs")).cast("int").alias("tb"))
    blank = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "v", "sbs", source_block,
                          F.explode(F.sequence(F.lit(0), F.col("tbs") - 1)).alias("tb"))
    other = F.explode(F.sequence(F.lit(0), F.col("sbs") - 1)).alias("ob")
    placed = dense.unionByName(blank).select("lang", "source", "term", "p", "v", "sb", "tb", other).select(
        "*", F.least("sb", "ob").alias("a"), F.greatest("sb", "ob").alias("b"))
    parts = placed.groupBy("lang", "tb", "a", "b").applyInArrow(_block_distances, "lang string, x string, y string, value long")
    summed = parts.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    both = summed.select("lang", "value", F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")),
                                                            F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("s"))
    pairs = both.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(any_value(s), 0) AS ng FROM d LEFT JOIN (SELECT lang, source, sum(n) AS s FROM c GROUP BY lang, source) AS t USING (lang, source) GROUP BY lang, source),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (nl + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)
      JOIN (SELECT lang, sum(n) AS nl FROM c GROUP BY lang) USING (lang) JOIN v USING (lang)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (ng + 5 * v) AS p
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p AS x JOIN p AS y USING (lang, term)
          WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50
"""


@query("op12_divergence", ORACLE)
def op12_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))
