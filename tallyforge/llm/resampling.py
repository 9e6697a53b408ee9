"""Importance resampling toward a target: array-scored weights, then weighted median-of-medians selection.

Hashed features (runs of words) of every document are written once as an array of buckets. Bucket
counts of the corpus and of the target give one gain per bucket; a document's weight is the sum of
its buckets' gains, taken over the Arrow buffers of the arrays. With a Gumbel number drawn from the
hash of the document's id, the best scores are a draw without replacement by those weights.

The cutoff is found without sorting the table. Each task gives the median of every chunk of
candidates it reads on either side of the last pivot; the median of these medians, weighted by the
chunks' sizes, is the next pivot, so at least a quarter of the candidates goes in every pass, until
the pivot is the cutoff or so few are left that one small task sorts them. Candidates are rewritten
when they have become an eighth, so all passes together read a small multiple of the table. Only the
winners are sorted, by ranges of the order, each range numbered from the rows before it.

To the driver come `buckets` counts, and one median for every CHUNK candidates and task. Texts don't
move; buckets do as counts, summed in the tasks first.

Null texts have no words, weight 0, and are never drawn where `min_words` is above 0. A null doc_id
is hashed as an empty text and comes after all others in a tie. Rows that share a doc_id are documents
of their own; of equal scores and ids the one with fewer features comes first, and rows that are
alike in these too get consecutive ranks. Only doc_id and text are read, so other columns may have any
name. An empty target gives every bucket the same odds; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.llm.common import arrow_map, query, table
from tallyforge.session import settle

BUCKETS = 10_000
CHUNK = 1 << 20
# Candidates that one task may sort, and the shrinkage that is worth writing them anew.
LAST, SHRUNK = 8192, 8
# The order of the draw: score falling, doc_id rising with nulls last, then fewer features.
KEY = ("k_score", "k_null", "k_id", "k_features")


def _word_runs(n: int) -> Column:
    """Every `n` consecutive words of the column `words`, joined by a space."""
    run = lambda i: F.concat_ws(" ", *(F.get("words", i + k) for k in range(n)))
    return F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - n), run)).otherwise(F.array().cast("array<string>"))


def bucket_arrays(docs: DataFrame, ngrams: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """`docs` with `n_words` and `buckets` in place of `text`: the bucket of every run of ngrams[0] to ngrams[1] words."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(F.coalesce(lower, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    runs = [F.col("words") if n == 1 else _word_runs(n) for n in range(ngrams[0], ngrams[1] + 1)]
    features = runs[0] if len(runs) == 1 else F.concat(*runs)
    places = F.transform(features, lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))
    return docs.withColumn("words", words).select(*(c for c in docs.columns if c != "text"), F.size("words").cast("long").alias("n_words"), places.alias("buckets"))


def bucket_counts(arrays: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features lie in each bucket."""
    counts = np.zeros(buckets, np.int64)
    for bucket, n in arrays.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect():
        counts[bucket] = n
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's smoothed share over the corpus's) per bucket."""
    m, s, t = len(corpus), corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * float(corpus.sum() + m) / ((s + 1) * float(target.sum() + m)))).astype(np.int64)


def weighted(arrays: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of a document's features."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists = batch.column("buckets")
            at = np.asarray(lists.offsets).astype(np.int64)
            at -= at[0]
            sums = np.concatenate(([0], np.cumsum(gains[np.asarray(lists.flatten())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(np.diff(at)), pa.array(sums[at[1:]] - sums[at[:-1]])],
                ["doc_id", "n_words", "n_features", "weight"])

    return arrow_map(arrays.select("doc_id", "n_words", "buckets"), run, "doc_id long, n_words long, n_features long, weight long")


def with_scores(weights: DataFrame, seed: int) -> DataFrame:
    """Adds `score`: the weight and a thousandfold Gumbel number from the hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weights.withColumn("score", F.col("weight") + gumbel)


def _keyed(scored: DataFrame) -> DataFrame:
    return scored.withColumns({"k_score": -F.col("score"), "k_null": F.col("doc_id").isNull().cast("long"),
                               "k_id": F.coalesce("doc_id", F.lit(0)), "k_features": F.col("n_features")})


def _tuple(key: tuple[int, ...]) -> Column:
    return F.struct(*(F.lit(v).cast("long").alias(c) for v, c in zip(key, KEY)))


def _chunk_median(rows: np.ndarray) -> tuple[int, ...]:
    """The lower median of a chunk's keys in linear time: by the first part, ties by the others."""
    half = (len(rows) - 1) // 2
    first = np.partition(rows[:, 0], half)[half]
    ties = rows[rows[:, 0] == first]
    order = np.lexsort(ties.T[:0:-1])
    return tuple(int(v) for v in ties[order[half - int((rows[:, 0] < first).sum())]])


def _sides(rows: np.ndarray, pivot: tuple[int, ...]) -> np.ndarray:
    """-1, 0 or 1 for keys before, at and after the pivot."""
    side = np.zeros(len(rows), np.int64)
    for column, value in zip(rows.T, pivot):
        side = np.where(side == 0, np.sign(column - value), side)
    return side


def chunk_medians(keys: DataFrame, pivot: tuple[int, ...] | None, chunk: int = CHUNK) -> list[tuple[int, tuple[int, ...], int]]:
    """(side of the pivot, median, size) of every chunk of every task."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> list[tuple]:
            rows = np.concatenate(held)
            sides = _sides(rows, pivot) if pivot is not None else np.ones(len(rows), np.int64)
            return [(s, *_chunk_median(part), len(part)) for s in (-1, 0, 1) if len(part := rows[sides == s])]

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told())], ["side", *KEY, "n"])

        for batch in stream:
            if batch.num_rows:
                held.append(np.stack([np.asarray(batch.column(c)) for c in KEY], axis=1))
            if sum(map(len, held)) >= chunk:
                yield emit()
                held.clear()
        if held:
            yield emit()

    found = arrow_map(keys.select(*KEY), run, "side long, " + ", ".join(f"{c} long" for c in KEY) + ", n long").collect()
    return [(r[0], tuple(r[1:-1]), r[-1]) for r in found]


def weighted_median(medians: list[tuple[tuple[int, ...], int]]) -> tuple[int, ...]:
    total, passed = sum(n for _, n in medians), 0
    for key, n in sorted(medians):
        passed += n
        if 2 * passed >= total:
            return key
    raise ValueError("no medians")


def cutoff(keys: DataFrame, need: int, chunk: int = CHUNK, last: int = LAST) -> tuple[int, ...]:
    """The `need`-th key (from 1) of a table that has at least so many rows."""
    left, pivot, written = keys, None, None
    low = high = None
    while True:
        found = chunk_medians(left, pivot, chunk)
        if pivot is not None:
            before, at = (sum(n for s, _, n in found if s == side) for side in (-1, 0))
            if before < need <= before + at:
                return pivot
            low, high, side, need = (low, pivot, -1, need) if need <= before else (pivot, high, 1, need - before - at)
            found = [x for x in found if x[0] == side]
        size = sum(n for _, _, n in found)
        written = written or size
        left = keys
        for bound, keep in ((low, lambda k, b: k > b), (high, lambda k, b: k < b)):
            if bound is not None:
                left = left.where(keep(F.struct(*KEY), _tuple(bound)))
        if size <= last:
            return tuple(left.orderBy(*KEY).limit(need).agg(F.max(F.struct(*KEY)).alias("k")).first()["k"])
        if size * SHRUNK <= written:
            keys = left = settle(left)
            low, high, written = None, None, size
        pivot = weighted_median([(k, n) for _, k, n in found])


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """`rows` with their place (from 1) in the order of KEY: ranges sorted each for itself, counted, and moved by the rows before."""
    placed = settle(rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    moves, before = [], 1
    for k, n in sorted(placed.groupBy(part.alias("part")).count().collect()):
        moves.append((k, before))
        before += n
    spark = rows.sparkSession
    starts = F.broadcast(spark.createDataFrame(moves, "_part long, _before long"))  # one row per range
    return (placed.withColumn("_part", part).join(starts, "_part")
            .withColumn(out, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at"))


def resample(docs: DataFrame, target: DataFrame, ngrams: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: int = 2024,
             min_words: int = 20, percent: int = 10, chunk: int = CHUNK, last: int = LAST) -> DataFrame:
    """doc_id, n_features, weight, score, and rank among the drawn `percent` of the documents of at least `min_words` words."""
    arrays = settle(bucket_arrays(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ngrams, buckets))
    wanted = bucket_counts(bucket_arrays(target.select("text"), ngrams, buckets), buckets)
    gains = bucket_gains(bucket_counts(arrays, buckets), wanted)
    scored = settle(_keyed(with_scores(weighted(arrays, gains), seed)))
    shown = ["doc_id", "n_features", "weight", "score"]
    open_ = scored.where(F.col("n_words") >= min_words)
    draws = percent * open_.count() // 100
    if draws == 0:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    limit = _tuple(cutoff(open_, draws, chunk, last))
    won = (F.col("n_words") >= min_words) & (F.struct(*KEY) <= limit)
    ranked = numbered(scored.where(won), "rank")
    # Rows that are alike in all parts of the key may stand on both sides of the last place.
    return (ranked.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank"))).select(*shown, "rank")
            .unionByName(scored.where(~won).select(*shown, F.lit(None).cast("long").alias("rank"))))


# CRC-32 by its byte table, made from the polynomial; every other step is plain aggregation.
ORACLE = r"""
WITH steps AS (SELECT i, list_reduce([i::UBIGINT] || list_transform(range(8), lambda k: k::UBIGINT),
                      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM steps),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(ws) AS w FROM b),
words AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
hexes AS (SELECT w, hex(encode(w)) AS x FROM words),
placed AS (SELECT w, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::UBIGINT),
           lambda c, y: xor(c >> 8, t[(xor(c, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket FROM hexes, crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN placed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN placed USING (w) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS sn, (SELECT count(*) FROM bw)::DOUBLE AS tn),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (sn + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (tn + 10000))))::BIGINT AS g
          FROM s FULL JOIN t USING (bucket), n),
weights AS (SELECT r, sum(g)::BIGINT AS weight FROM dw JOIN placed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
           coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM ranked) THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (r)
"""


@query("op13_resampling", ORACLE)
def op13_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
