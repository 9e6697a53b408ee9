"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target may be up to twice its size, so a document gets the whole copies that its source's ratio
of target to size holds, and the fraction that is left is the chance of one more. Which documents get it is a
balanced sample: a flight moves three documents' chances at a time along the one direction that keeps both
the sum of words and the number of documents (the null space of these constraints), until one of the three is
0 or 1. Rounds take disjoint triples of all that are still open, as arrays. Before them each document of
GIANT times the median size flies against all smaller ones of its block together, a wider direction of the
same null space, since a few small ones can't outweigh it. Documents of a source are dealt into blocks by a hash; a block flies until at most LANDING documents are open, those of all blocks meet in
new blocks, and so on until a source has one block. There the landing problem, at most LANDING documents,
is solved by trying all outcomes: the one whose words come nearest to the target, then whose number of
documents does. So a source misses its target by what a best choice among its last documents leaves.

Only ids and sizes move. Equal rows (same doc_id, source and size) are one unit with a count: whole
copies for as many rows as their chances add up to, and one open chance; they are dealt out to rows again
at the end. Blocks depend on hashes of ids and directions on hashes of blocks, so reruns and other
partitionings give the same rows; every level is written to the shared folder.

Targets: sources ordered by code point, null last, weigh `weights` in turn and share `share` of all words;
where a target exceeds `most` times its source's size it stops there, and a level of fill that solves this is
found by a few aggregations over the table of sources.

Null texts have size 0 and empty ones too: they are documents in the balance but take no words. A source
without words has target 0. Null doc_ids are units like others. Only doc_id, source and text are read, so
other columns may have any name; the result is joined to them by doc_id. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.functions.ordered import exact_rank
from tallyforge.llm.common import query, table
from tallyforge.session import bounded_broadcast, settle

BLOCK = 1000
LANDING = 12
GIANT = 4
ROWS_A_PIECE = 10_000


def source_targets(units: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """source, source_size, target, and the ratio of both, for every source of `units` (source, size, rows)."""
    sizes = settle(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
                   .withColumn("last", F.col("source").isNull().cast("int")))
    turn = F.get(F.array(*map(F.lit, weights)), ((F.col("rn") - 1) % len(weights)).cast("int"))
    filled = settle(exact_rank(sizes, [], ["last", "source"]).select("source", "source_size", turn.alias("weight"), (F.col("source_size") * most).alias("cap")))
    # The fill level: what isn't taken by full sources over the weights of the others, until no further one is full.
    level, full = 0.0, -1
    while True:
        is_full = F.lit(level) * F.col("weight") >= F.col("cap")
        row = filled.agg(F.count_if(is_full).alias("full"), F.sum("source_size").alias("words"), F.sum(F.when(is_full, F.col("cap")).otherwise(0)).alias("taken"),
                         F.sum(F.when(is_full, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if row["full"] == full or not row["words"] or not row["weight"]:
            break
        full, level = row["full"], (share * row["words"] - row["taken"]) / row["weight"]
    target = F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double"))
    return filled.select("source", "source_size", target.alias("target"), F.coalesce(F.try_divide(target, F.col("source_size").cast("double")), F.lit(0.0)).alias("ratio"))


def _moved(chance: np.ndarray, way: np.ndarray, draw: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of chances one step along or against `way`, as far as the first of them gets to 0 or 1; no move is expected."""
    moves = way != 0
    step = np.where(moves, way, 1.0)
    ahead, back = (np.where(moves, np.where(step * sign > 0, 1 - chance, chance) / np.abs(step), np.inf) for sign in (1, -1))
    far, near = ahead.min(axis=1), back.min(axis=1)
    forward = draw * (far + near) < near
    moved = np.clip(chance + np.where(forward, far, -near)[:, None] * way, 0.0, 1.0)
    row, hit = np.arange(len(chance)), np.where(forward, ahead.argmin(axis=1), back.argmin(axis=1))
    moved[row, hit] = (way[row, hit] > 0) == forward
    return np.where(moved < 1e-12, 0.0, np.where(moved > 1 - 1e-12, 1.0, moved))


def giants_first(chance: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Moves the chances of the largest documents to 0 or 1 where the smaller open ones can outweigh them."""
    chance, size = chance.copy(), size.astype(float)
    live = np.flatnonzero((chance > 0) & (chance < 1))
    if len(live) <= LANDING:
        return chance
    giants = live[size[live] > GIANT * max(1.0, np.median(size[live]))]
    for k in giants[np.argsort(-size[giants], kind="stable")]:
        while 0 < chance[k] < 1:
            small = np.flatnonzero((chance > 0) & (chance < 1) & (size < size[k]))
            free, s = np.minimum(chance[small], 1 - chance[small]), size[small]
            n, w, q = free.sum(), (free * s).sum(), (free * s * s).sum()
            if len(small) < LANDING or n * q - w * w <= 1e-9 * n * q:
                break
            # The share of each small one's room that makes up for one in number and for size[k] in words.
            way = -free * ((q - w * size[k]) + (n * size[k] - w) * s) / (n * q - w * w)
            at = np.append(small, k)
            chance[at] = _moved(chance[at][None, :], np.append(way, 1.0)[None, :], draw.random(1))[0]
    return chance


def flight(chance: np.ndarray, size: np.ndarray, draw: np.random.Generator, stop: int = LANDING) -> np.ndarray:
    """Moves chances to 0 or 1, keeping their sum and the sum of size x chance, until at most `stop` are open."""
    chance = giants_first(chance, size, draw)
    while len(live := np.flatnonzero((chance > 0) & (chance < 1))) > max(2, stop):
        at = live[:len(live) // 3 * 3].reshape(-1, 3)
        p, s = chance[at], size[at].astype(float)
        way = np.stack([s[:, 1] - s[:, 2], s[:, 2] - s[:, 0], s[:, 0] - s[:, 1]], axis=1)
        way[(way == 0).all(axis=1)] = (1.0, -1.0, 0.0)  # equal sizes: any direction that keeps the number
        way /= np.abs(way).max(axis=1, keepdims=True)
        chance[at] = _moved(p, way, draw.random(len(at)))
    return chance


def land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The outcome of the open chances whose words, then whose number, are nearest to what is expected."""
    live = np.flatnonzero((chance > 0) & (chance < 1))
    outcomes = np.array(list(itertools.product((0.0, 1.0), repeat=len(live))))
    off = outcomes - chance[live]
    best = np.lexsort((np.abs(off.sum(axis=1)), np.abs(off @ size[live].astype(float)).round(6)))[0]
    done = chance.copy()
    done[live] = outcomes[best]
    return done


def _fly(seed: int, level: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        source, block = (k.as_py() for k in key)
        rows = rows.sort_by([("mixed", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        size, chance = np.asarray(rows.column("size")), np.asarray(rows.column("chance"))
        draw = np.random.default_rng([seed, level, block, zlib.crc32((source or "").encode()), source is None])
        chance = flight(chance, size, draw)
        if rows.column("blocks")[0].as_py() == 1:
            chance = land(chance, size)
        return rows.set_column(rows.schema.get_field_index("chance"), "chance", pa.array(chance))

    return run


def balanced(units: DataFrame, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """`units` (source, doc_id, size, rows, sure, chance) with every chance moved to 0 or 1."""
    open_, done, level = units.withColumn("mixed", F.xxhash64("doc_id", "size")), [], 0
    shown = [*units.columns]
    while True:
        is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(open_.where(~is_open).select(*shown))
        per_source = bounded_broadcast(open_.where(is_open).groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
                                       .withColumnRenamed("source", "of"))
        if per_source.isEmpty():
            return _union(done)
        dealt = open_.where(is_open).join(per_source, F.col("source").eqNullSafe(F.col("of")))
        dealt = dealt.select(*shown, "mixed", "blocks", F.pmod(F.xxhash64("mixed", F.lit(level)), F.col("blocks")).cast("int").alias("block"))
        flown = dealt.groupBy("source", "block").applyInArrow(_fly(seed, level), dealt.schema)
        open_, level = settle(flown).drop("blocks", "block"), level + 1


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def word_count(text: str = "text"):
    """Runs of anything but space and tab to carriage return."""
    blank = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(blank, " \t\n\x0b\x0c\r", "")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words), one row per row of `docs`."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"))
    units = settle(sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows")))
    targets = bounded_broadcast(source_targets(units, weights, share, most).withColumnRenamed("source", "of"))
    joined = units.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("whole", F.floor("ratio"))
    expected = F.col("rows") * (F.col("ratio") - F.col("whole"))
    chances = joined.select("source", "doc_id", "size", "rows", "source_size", "target", "whole", F.floor(expected).alias("sure"), (expected - F.floor(expected)).alias("chance"))
    found = balanced(settle(chances), seed, block).withColumn("more", F.col("sure") + F.col("chance").cast("long"))
    # Many equal rows are dealt out in pieces, which tasks share.
    single = found.where("rows = 1").withColumn("copies", F.col("whole") + F.col("more"))
    pieces = found.where("rows > 1").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / ROWS_A_PIECE))).alias("piece")).repartition("doc_id", "size", "piece")
    first = F.col("piece") * ROWS_A_PIECE
    places = F.explode(F.sequence(first, F.least(first + ROWS_A_PIECE, F.col("rows")) - 1))
    several = pieces.select("*", places.alias("place")).withColumn("copies", F.col("whole") + F.when(F.col("place") < F.col("more"), 1).otherwise(0))
    shown = ["doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")]
    return single.select(*shown).unionByName(several.select(*shown))


@query("op11_mixing")
def op11_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
