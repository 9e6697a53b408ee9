"""Connected components of a link table, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge.session import settle


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (smallest node reachable) for every node of `links` (columns a, b: longs, any direction).

    Alternates the large-star and the small-star step: links to larger neighbours are hung on the
    smallest neighbour, then those to smaller ones. Each step is one minimum per node, combined
    map-side, and a join that adaptive execution may split at a hot node. Every round is written to
    the shared folder, so a lost executor costs a re-read. Stops when the links no longer change;
    rounds grow with the logarithm of the longest path.
    """
    now = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("m")).agg(F.least(F.min("b"), F.col("m")).alias("low"))
        large = (both.where("b > a").join(low, F.col("a") == F.col("m")).select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .where("a <> b").distinct())
        large = settle(large)
        least = large.groupBy(F.col("a").alias("m")).agg(F.min("b").alias("low"))
        hung = large.join(least, F.col("a") == F.col("m")).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = settle(hung.unionByName(least.select(F.col("m").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct())
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))


def _mark(links: DataFrame) -> tuple:
    """Count and checksum of a link table."""
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(a, b) % 1000003 as bigint))")).first())
