"""SimHash near-dedup over vantage-point trees.

A fingerprint has a bit where more than half of the text's shingle hashes have it. Equal
fingerprints are one point. Points are dealt to shards by vantage-point trees: at each node the
Hamming distance to the vantage point, against the node's radius, says inside or outside. By the
triangle inequality a point can only have neighbours within reach across a boundary if its own
distance is that close to the radius, so only such points visit the other side as well. Each
shard then joins its points with themselves and with its visitors, by a local tree of the same
kind that prunes until a block is small enough to compare bit by bit.

There is a tree for each of `TREES` groups of bits. Two fingerprints within `max_bits` are within
`max_bits // TREES` on at least one group, and distances on a group obey the triangle inequality
too. A narrow reach leaves few points near a boundary: on random fingerprints a level of the tree
multiplies visitors by 1.3, where one tree over all 64 bits with reach 4 multiplies them by 1.7.
Every pair within `max_bits` meets in a shard in which one of the two is at home, and is compared
on all bits, so the links are exact.

A shard hands on a spanning forest of the links it found, not all pairs, so a group of thousands
of near copies costs as many links as it has members. Components are found by Spark joins.

The trees are fitted on at most `sample_rows` points, picked by hash; they decide where points meet,
never whether. Null texts have no words and the fingerprint zero. Rows with a null doc_id link
like others but name no component: where all have none, component_id is null. Repeated rows and
repeated ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import arrow_map, extended, query, table
from tallyforge.llm.components import components
from tallyforge.session import settle

TREES = 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:n - 1].tolist()]
    stops = (ends[len(words) - n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Another hash of each hash; number 0 leaves them as they are."""
    if not number:
        return hashes
    x = hashes ^ np.uint64(0x9E3779B97F4A7C15 * number % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):  # bounded memory for long texts
        part = hashes[start:start + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle_words: int = 4, number: int = 0) -> int:
    """64 bits of the words of `text`, A-Z lower-cased; zero without words. Each `number` is a fingerprint of its own."""
    return _majority(_mixed(_hashes(text, shingle_words), number))


def fingerprints(docs: DataFrame, shingle_words: int = 4, tables: int = 1) -> DataFrame:
    """`doc_id` and its fingerprints `fps`, as signed longs."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = np.zeros((batch.num_rows, tables), np.uint64)
            for start in range(0, batch.num_rows, 256):
                for k, text in enumerate(batch.column(1).slice(start, 256).to_pylist()):
                    hashes = _hashes(text, shingle_words)
                    found[start + k] = [_majority(_mixed(hashes, t)) for t in range(tables)]
            offsets = pa.array(np.arange(0, batch.num_rows * tables + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1).view(np.int64)))], names=["doc_id", "fps"])

    return docs.select("doc_id", "text").transform(arrow_map, run, extended(docs.select("doc_id").schema, "fps array<long>"))


def bits_between(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


Tree = tuple | int


def grow(sample: np.ndarray, leaf: int) -> tuple[Tree, int]:
    """A vantage-point tree over `sample` with at most `leaf` of its points in a shard: nested (point, radius, inside, outside), and the shards."""
    count = 0

    def node(points: np.ndarray, tries: int) -> Tree:
        nonlocal count
        if len(points) > leaf and tries:
            pivot = points[len(points) // 2]
            far = bits_between(points, pivot)
            radius = int(np.median(far))
            inside = far <= radius
            if inside.all():
                inside = far < radius
                radius -= 1
            if inside.any() and not inside.all():
                return (int(pivot), radius, node(points[inside], tries - 1), node(points[~inside], tries - 1))
        count += 1
        return count - 1

    return node(sample, 24), count


def route(tree: Tree, points: np.ndarray, max_bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indexes into `points`, at home) for every shard that a point has to be in."""
    todo = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, rows, home = todo.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            yield node, rows, home
            continue
        pivot, radius, inside, outside = node
        far = bits_between(points[rows], np.uint64(pivot))
        # A pair across the boundary needs one of the two to call on the other: the one at home outside does,
        # and from then on it is a visitor that goes wherever a point of the inside may be near it.
        near_in = (far <= radius) | (far <= radius + max_bits)
        near_out = (far > radius) | (~home & (far > radius - max_bits))
        todo.append((inside, rows[near_in], (home & (far <= radius))[near_in]))
        todo.append((outside, rows[near_out], home[near_out]))


Found = Callable[[np.ndarray, np.ndarray], None]
_BLOCK = 1 << 21


def _compare(points: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int, found: Found) -> None:
    step = max(1, _BLOCK // max(1, len(b)))
    for s in range(0, len(a), step):
        part = a[s:s + step]
        i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[b][None, :]) <= max_bits)
        if len(i):
            found(part[i], b[j])


def near_pairs(points: np.ndarray, seen: np.ndarray, a: np.ndarray, b: np.ndarray | None, reach: int, max_bits: int, found: Found, depth: int = 0) -> None:
    """Calls `found` with index pairs within `max_bits` that are within `reach` on the bits in `seen`: of `a` with `b`, or of `a` with itself where `b` is None."""
    mates = a if b is None else b
    if not len(a) or not len(mates):
        return
    if len(a) * len(mates) <= 1 << 18 or depth >= 40 or len(a) < 64:
        _compare(points, a, mates, max_bits, found)
        return
    pivot = seen[a[7919 * (depth + 1) % len(a)]]
    far_a = bits_between(seen[a], pivot)
    radius = int(np.median(far_a))
    inside = far_a <= radius
    if inside.all():
        radius -= 1
        inside = far_a <= radius
        if not inside.any():
            _compare(points, a, mates, max_bits, found)
            return
    if b is None:
        near_pairs(points, seen, a[inside], None, reach, max_bits, found, depth + 1)
        near_pairs(points, seen, a[~inside], None, reach, max_bits, found, depth + 1)
        near_pairs(points, seen, a[inside & (far_a > radius - reach)], a[~inside & (far_a <= radius + reach)], reach, max_bits, found, depth + 1)
    else:
        far_b = bits_between(seen[b], pivot)
        near_pairs(points, seen, a[inside], b[far_b <= radius + reach], reach, max_bits, found, depth + 1)
        near_pairs(points, seen, a[~inside], b[far_b > radius - reach], reach, max_bits, found, depth + 1)


class Forest:
    """Roots of `n` indexes under links that come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            ri, rj = self.root[i], self.root[j]
            differ = ri != rj
            if not differ.any():
                return
            i, j, ri, rj = i[differ], j[differ], ri[differ], rj[differ]
            np.minimum.at(self.root, np.maximum(ri, rj), np.minimum(ri, rj))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def shard_links(points: np.ndarray, seen: np.ndarray, home: np.ndarray, reach: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what the links among `points` at home, and between them and visitors, connect."""
    forest = Forest(len(points))
    own, visitors = np.flatnonzero(home), np.flatnonzero(~home)
    near_pairs(points, seen, own, None, reach, max_bits, forest.link)
    near_pairs(points, seen, own, visitors, reach, max_bits, forest.link)
    hung = np.flatnonzero(forest.root != np.arange(len(points)))
    return hung, forest.root[hung]


def near_links(points: DataFrame, max_bits: int = 4, tables: int = 1, sample_rows: int = 65_536, shard_rows: int = 32_768) -> DataFrame:
    """Links a, b (node ids) that connect exactly the `points` (t, node, fp; fp unique in its table t) within `max_bits` of each other.

    Points of different tables never meet. Each level of a tree makes more visitors, so shards are as
    large as a task easily holds (a point is 17 bytes).
    """
    share = max(4, -(-points.count() // (sample_rows * tables)))
    rows = points.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).select("t", "fp").toPandas()
    cut = np.linspace(0, 64, TREES + 1).astype(int).tolist()
    masks = [np.uint64((1 << b) - (1 << a)) for a, b in zip(cut, cut[1:])]
    grown = []
    for t in range(tables):
        own = np.sort(rows.fp[rows.t == t].to_numpy(np.int64)).view(np.uint64)
        sample = np.random.default_rng(7).permutation(own)
        grown += [grow(sample & mask, max(16, shard_rows // share)) for mask in masks]
    first = np.cumsum([0, *(n for _, n in grown)])
    trees = [tree for tree, _ in grown]
    reach = max_bits // TREES

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 65_536):
                part = batch.slice(start, 65_536)
                table_of = part.column(0).to_numpy(zero_copy_only=False)
                all_fps = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for t in np.unique(table_of).tolist():
                    mine = np.flatnonzero(table_of == t)
                    fps, nodes = all_fps[mine], part.column(1).take(pa.array(mine))
                    for k, mask in enumerate(masks):
                        number = t * TREES + k
                        for shard, at, home in route(trees[number], fps & mask, reach):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(at), first[number] + shard, np.int32)), nodes.take(pa.array(at)),
                                 pa.array(fps[at].view(np.int64)), pa.array(home)], names=["shard", "node", "fp", "home"])

    def join(shard: pa.Table) -> pa.Table:
        fps = shard.column("fp").to_numpy().view(np.uint64)
        k = (int(np.searchsorted(first, shard.column("shard")[0].as_py(), side="right")) - 1) % TREES
        i, j = shard_links(fps, fps & masks[k], shard.column("home").to_numpy(zero_copy_only=False).astype(bool), reach, max_bits)
        ids = shard.column("node").to_numpy()
        return pa.table({"a": pa.array(ids[i], pa.int64()), "b": pa.array(ids[j], pa.int64())})

    return (points.select("t", "node", "fp").transform(arrow_map, deal, "shard int, node long, fp long, home boolean")
            .groupBy("shard").applyInArrow(join, "a long, b long"))


def near_dedup(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4, tables: int = 1, sample_rows: int = 65_536, shard_rows: int = 32_768) -> DataFrame:
    """doc_id, fp (the first fingerprint) and component_id (smallest doc_id reachable over links), one row per row of `docs`.

    With several `tables` each text has as many independent fingerprints and is linked over any of
    them, which finds texts that are less alike: one fingerprint differs in 4 or fewer bits for half
    of the pairs with a shingle similarity of 0.95 and a fifth of those with 0.9.
    """
    marked = settle(fingerprints(docs, shingle_words, tables))
    # A node is a fingerprint (or the hash of several), so that rows without an id link and bridge too.
    name = F.get("fps", F.lit(0)) if tables == 1 else F.xxhash64("fps")
    nodes = settle(marked.groupBy("fps").agg(F.min("doc_id").alias("id")).withColumn("node", name))
    tall = nodes.select("node", F.posexplode("fps").alias("t", "fp"))
    # Texts may share one fingerprint and differ in another: a point has one node, the others hang on it.
    points = settle(tall.groupBy("t", "fp").agg(F.min("node").alias("node")))
    links = near_links(points, max_bits, tables, sample_rows, shard_rows)
    if tables > 1:
        links = links.unionByName(tall.join(points.withColumnRenamed("node", "b"), ["t", "fp"]).where("node <> b").select(F.col("node").alias("a"), "b"))
    roots = components(links)
    named = (nodes.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
             .select("fps", "id", F.coalesce("root", "node").alias("root")))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "root").select("fps", "component_id")
    return marked.join(named, "fps", "left").select("doc_id", F.get("fps", F.lit(0)).alias("fp"), "component_id")


@query("op8_simhash")
def op8_simhash(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
