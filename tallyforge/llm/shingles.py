"""Groups of texts whose shingle sets have a Jaccard similarity of at least 0.8, all of them and no others.

A text is the set of hashes of its five-word shingles; equal sets are one node. Every set is ordered
alike: shingles that many texts of a small sample hold come last, hashes decide among the rest. Two
sets x, y from 0.8 share at least `ceil(0.8 max(|x|, |y|))` shingles, so of the first
`|x| - ceil(0.8 |x|) + l` of each, its prefix, at least l are common (l = `_least` of the smaller set):

1. Prefixes are dealt to buckets by hash, packed, and only (shingle, node) rows of shingles in several
   prefixes leave them. A node goes on if it has enough of these. A corpus without near copies ends here
   but for texts made of boilerplate.
2. Every node gets SimHash fingerprints of its set. Those within 4 bits meet through the vantage-point trees of
   `simhash`, and the spanning forests they come back as are compared exactly. Links make components: a large group
   of near copies becomes one or a few, for a bounded number of comparisons per node. Where they leave components
   apart, a node is also compared with the least and the greatest node of each of its bands (equal minima of hashes
   of the sets, which sets far from equal still have).
3. Nodes of different components that share enough prefix shingles are paired and compared exactly.
   Nodes of one component never are, so a large group of near copies costs its members, not its pairs.

Step 3 leaves no pair out: the components are those of all pairs from 0.8. Sample, fingerprints and bands decide how
many pairs are looked at, never which are linked. What remains quadratic is a shingle that is rare
by the sample and in the prefix of many texts that are not alike.

Sets are written once (8 bytes a shingle) and compared as whole numbers. Hashes and nodes have 64 bits; texts
with fewer words than a shingle are one shingle, texts without words are one node. Columns of the input
keep their names beside `group`; those named node or shingles are an error of the caller, who renames them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import arrow_map, extended
from tallyforge.llm.components import components
from tallyforge.llm.simhash import _hashes, _majority, _mixed, near_links
from tallyforge.session import bounded_broadcast, settle

SAMPLE_TEXTS = 4096
# Common shingles of the sample that are put last; the others count as rare.
SAMPLE_SHINGLES = 400_000
BUCKET_TOKENS = 400_000
CROWD_PAIRS = 1000
# Fingerprints a set, each linked to those within MAX_BITS of its own kind.
FINGERPRINTS, MAX_BITS = 4, 4
# Minima a band and bands a set: of two sets from 0.8, nine in ten pairs have a band in common.
BAND, BANDS = 8, 16
# A prefix is longer by a shingle for every so many of the set: longer prefixes tell unlike sets apart without fetching them.
LEAST = 10


def _least(n: int) -> int:
    """How many prefix shingles two sets must share if the smaller one has `n`."""
    return n // LEAST + 1


def _early(n: int) -> int:
    """The length of the prefix that is enough for the smaller of two sets: both share 4/9 of the sum of their sizes."""
    return min(n, n - -(-8 * n // 9) + _least(n))


def _common(n: int) -> int:
    """Shingles that a set of `n` shares with any set from 0.8."""
    return -(-4 * n // 5)


def shingle_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """`docs` with its text replaced by node (the same for equal sets) and shingles (distinct hashes)."""
    at = docs.columns.index("text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [np.unique(_hashes(t, shingle_words)) for t in part.column(at).to_pylist()]
                nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                rest = [c for k, c in enumerate(part.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(nodes), lists], names=[*others, "node", "shingles"])

    others = [c for c in docs.columns if c != "text"]
    return docs.transform(arrow_map, run, extended(docs.drop("text").schema, "node long, shingles array<long>"))


class Order:
    """The order of shingles: how many texts of the sample hold it, then its hash."""

    def __init__(self, common: dict[int, int]):
        self.common = np.array(sorted(common), np.int64)
        self.counts = np.array([common[c] for c in sorted(common)], np.int64)

    def prefix(self, shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        size = min(n, n - _common(n) + _least(n))
        held = np.zeros(n, np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
            held = np.where(self.common[at] == shingles, self.counts[at], 0)
        return shingles[np.lexsort((shingles, held))[:size]]


def _sample_order(sets: DataFrame) -> Order:
    share = max(1, sets.count() // SAMPLE_TEXTS)
    rows = sets.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).dropDuplicates(["node"])
    held = rows.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return Order({r["shingle"]: r["n"] for r in held.orderBy(F.desc("n"), "shingle").limit(SAMPLE_SHINGLES).collect()})


def _prefixes(batch: pa.RecordBatch, order: Order) -> Iterator[tuple[int, int, np.ndarray]]:
    """(node, size of its set, its prefix) of rows node, shingles."""
    for node, shingles in zip(batch.column(0).to_pylist(), batch.column(1)):
        own = shingles.values.to_numpy(zero_copy_only=False)
        yield node, len(own), order.prefix(own)


def shared_tokens(sets: DataFrame, order: Order) -> DataFrame:
    """token, node, early (within the prefix that is enough for a smaller set): the prefix shingles that several nodes have."""
    total = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // (4 * BUCKET_TOKENS)))

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [(node, own, n) for node, n, own in _prefixes(batch, order) if len(own)]
            if not found:
                continue
            tokens = np.concatenate([own for _, own, _ in found])
            nodes = np.repeat(np.array([node for node, _, _ in found], np.int64), [len(own) for _, own, _ in found])
            early = np.concatenate([np.arange(len(own)) < _early(n) for _, own, n in found])
            bucket = (tokens.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            which, first = np.unique(bucket[by], return_index=True)
            parts = np.split(by, first[1:])
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(which, pa.int64()), "tokens": pa.array([tokens[p].tobytes() for p in parts], pa.binary()),
                                              "nodes": pa.array([nodes[p].tobytes() for p in parts], pa.binary()), "early": pa.array([early[p].tobytes() for p in parts], pa.binary())})

    def shared(group: pa.Table) -> pa.Table:
        tokens, nodes = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64) for c in ("tokens", "nodes"))
        early = np.frombuffer(b"".join(group.column("early").to_pylist()), bool)
        by = np.lexsort((nodes, tokens))
        tokens, nodes, early = tokens[by], nodes[by], early[by]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])  # copies of a set are one node
        tokens, nodes, early = tokens[new], nodes[new], early[new]
        same = tokens[1:] == tokens[:-1]
        held = np.zeros(len(tokens), bool)
        held[1:] |= same
        held[:-1] |= same
        return pa.table({"token": pa.array(tokens[held], pa.int64()), "node": pa.array(nodes[held], pa.int64()), "early": pa.array(early[held])})

    return (sets.select("node", "shingles").transform(arrow_map, deal, "bucket long, tokens binary, nodes binary, early binary")
            .groupBy("bucket").applyInArrow(shared, "token long, node long, early boolean"))


def _enough(pairs: DataFrame) -> DataFrame:
    """a, b out of rows a, b, small (the smaller size), one per shingle in the prefix of the larger and the early prefix of the smaller set, that share enough."""
    # Sizes are the same in all rows of a pair.
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("small").alias("small"))
    return counted.where(F.col("n") >= F.floor(F.col("small") / LEAST) + 1).select("a", "b")


def _with_sets(pairs: DataFrame, side: str, sets: DataFrame) -> DataFrame:
    """`pairs` with the set of its node `side`; a node of very many pairs is dealt to several groups."""
    other = "b" if side == "a" else "a"
    crowd = bounded_broadcast(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD_PAIRS)
                              .select(side, F.ceil(F.col("n") / CROWD_PAIRS).alias("groups")))
    dealt = pairs.join(crowd, side, "left").withColumn("group", F.coalesce(F.pmod(F.xxhash64(other), F.col("groups")), F.lit(0))).drop("groups")
    named = sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}"))
    groups = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("groups") - 1, F.lit(0).cast("long")))
    held = named.join(crowd, side, "left").withColumn("group", F.explode(groups)).drop("groups")
    return dealt.join(held, [side, "group"]).drop("group")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The `pairs` a, b whose sets have a Jaccard similarity of at least 0.8."""
    both = _with_sets(_with_sets(settle(pairs), "b", sets), "a", sets)
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(9 * common >= 4 * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def _with_components(held: DataFrame, links: DataFrame) -> DataFrame:
    """`held` (token, node, size) with the component `c` of every node, for shingles that several components have."""
    roots = components(links).withColumnRenamed("root", "c")
    named = settle(held.join(roots, "node", "left").withColumn("c", F.coalesce("c", "node")))
    mixed = named.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    return settle(named.join(mixed, "token"))


def _fingerprinted(sets: DataFrame) -> DataFrame:
    """a, b: spanning forests of the nodes that have a fingerprint within MAX_BITS of each other."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = np.zeros((batch.num_rows, FINGERPRINTS), np.uint64)
            for k, shingles in enumerate(batch.column(1)):
                own = shingles.values.to_numpy(zero_copy_only=False).view(np.uint64)
                found[k] = [_majority(_mixed(own, t)) for t in range(FINGERPRINTS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(FINGERPRINTS, dtype=np.int32), batch.num_rows)),
                                              batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), FINGERPRINTS))), pa.array(found.reshape(-1).view(np.int64))], names=["t", "node", "fp"])

    tall = settle(sets.select("node", "shingles").transform(arrow_map, run, "t int, node long, fp long"))
    # Nodes of one fingerprint are one point: it has the least node, the others hang on it.
    points = settle(tall.groupBy("t", "fp").agg(F.min("node").alias("node")))
    hung = tall.join(points.withColumnRenamed("node", "b"), ["t", "fp"]).where("node <> b").select(F.col("node").alias("a"), "b")
    links = near_links(points, MAX_BITS, FINGERPRINTS).unionByName(hung)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The `pairs` a, b of different components of `links`."""
    roots = settle(components(links))
    both = pairs
    for side in ("a", "b"):
        both = both.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _banded(sets: DataFrame) -> DataFrame:
    """a, b: every node with the least and the greatest node of each of its bands, BAND equal minima of hashes of the sets."""
    draw = np.random.default_rng(8)
    odd, more = (draw.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) for _ in range(2))
    odd |= np.uint64(1)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for node, shingles in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = shingles.values.to_numpy(zero_copy_only=False).view(np.uint64)
                low = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
                for start in range(0, len(own), 1024):
                    low = np.minimum(low, (own[start:start + 1024, None] * odd + more).min(axis=0))
                names = [xxhash.xxh3_64_intdigest(part.tobytes(), seed=k) for k, part in enumerate(low.reshape(BANDS, BAND))]
                yield pa.RecordBatch.from_pydict({"band": pa.array(np.array(names, np.uint64).view(np.int64)), "node": pa.array([node] * BANDS, pa.int64()), "size": pa.array([len(own)] * BANDS, pa.int64())})

    rows = settle(sets.select("node", "shingles").transform(arrow_map, run, "band long, node long, size long"))
    of = F.struct("node", "size")
    ends = rows.groupBy("band").agg(F.min(of).alias("low"), F.max(of).alias("high")).where("low.node <> high.node")
    met = rows.join(ends, "band").select("node", "size", F.explode(F.array("low", "high")).alias("end")).where("node <> end.node")
    near = met.where(5 * F.least("size", "end.size") >= 4 * F.greatest("size", "end.size"))
    return near.select(F.least("node", "end.node").alias("a"), F.greatest("node", "end.node").alias("b")).distinct()


def similar_groups(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """`docs` (any columns and text) with the text replaced by `group`: equal for rows connected over pairs of texts from 0.8."""
    rows = settle(shingle_sets(docs, shingle_words))
    shared = settle(shared_tokens(rows, _sample_order(rows)))
    counts = bounded_broadcast(shared.groupBy("node").agg(F.count(F.lit(1)).alias("_shared")))
    least = F.floor(F.ceil(4 * F.size("shingles") / 5) / LEAST) + 1
    sets = settle(rows.select("node", "shingles").join(counts, "node").where(F.col("_shared") >= least)
                  .groupBy("node").agg(F.any_value("shingles").alias("shingles")))
    held = settle(shared.join(sets.select("node", F.size("shingles").alias("size")), "node"))

    links = settle(alike(_fingerprinted(sets), sets))
    links = settle(links.unionByName(alike(_apart(_banded(sets), links), sets)))
    mixed = _with_components(held, links)
    per = mixed.groupBy("token", "c").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("token").agg(F.max_by("c", F.struct("n", "c")).alias("main"))
    named = settle(mixed.join(main, "token"))
    x = named.where("c <> main").select("token", F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("c").alias("c_a"), F.col("early").alias("early_a"))
    y = named.select("token", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("c").alias("c_b"), F.col("early").alias("early_b"), (F.col("c") == F.col("main")).alias("is_main"))
    # Two nodes of different components are not both in the largest one; each pair comes once per common shingle.
    a_is_smaller = "(size_a < size_b OR (size_a = size_b AND a < b))"
    met = f"c_a <> c_b AND (is_main OR a < b) AND 5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b) AND (({a_is_smaller} AND early_a) OR (NOT {a_is_smaller} AND early_b))"
    across = x.join(y, "token").where(met)
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("size_a", "size_b").cast("int").alias("small"))
    last = alike(_enough(across), sets)
    groups = components(links.unionByName(last)).withColumnRenamed("root", "group")
    return rows.drop("shingles").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node")).drop("node")
