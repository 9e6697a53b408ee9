"""Exact order-dependent results without a window that fits in one task.

A plain `Window.orderBy` (or a window over a hot key) sorts one group in one task.
The helpers here cut such a group along the order itself, run the window inside each
piece, and stitch the pieces together with one total per piece.

A group of more than `hot_rows` rows is cut evenly between its own least and greatest
value into as many pieces as its rows ask for; a piece that is still too large is cut
again between its own ends, along the next order column where all its values are equal.
So pieces follow the rows of each group, however many groups are large and wherever
their values lie. What is large is measured before the plan is built, by one aggregation
per level that combines map-side. Pieces only balance the work; the results are exact
whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyforge.session import BROADCAST_BYTES, settle, stored_bytes

HOT_ROWS = 1_000_000
# A piece that stays large after so many cuts is kept: its work is unbalanced, its result right.
LEVELS = 8
# Text is cut by as many groups of six bytes, each a whole number that a double holds.
TEXT_GROUPS = 4


def _leads(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Doubles that never decrease along `order`: each only counts where those before it are equal."""
    leads = []
    for name in order:
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            data = F.col(name).cast("binary")
            for k in range(TEXT_GROUPS):
                leads.append(F.conv(F.rpad(F.hex(F.substring(data, 6 * k + 1, 6)), 12, "0"), 16, 10).cast("double"))
        elif isinstance(kind, T.NumericType):
            leads.append(F.col(name).cast("double"))
        else:
            break
    return leads


def with_pieces(df: DataFrame, part: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """Adds `_piece`, an array that never decreases along `order` within a part; and whether any part has several.

    Large pieces are a table of at most rows / hot_rows rows; it is broadcast while its files are small.
    """
    leads = _leads(df, order)
    keys = [*part, "_piece"]
    pieces = df.withColumn("_piece", F.array().cast("array<bigint>"))
    for level in range(LEVELS if leads else 0):
        ends = [f(lead).alias(f"{name}{i}") for i, lead in enumerate(leads) for name, f in (("_low", F.min), ("_high", F.max))]
        stats = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *ends)
        ready = F.coalesce(*[F.when(F.col(f"_low{i}") < F.col(f"_high{i}"), F.lit(i)) for i in range(len(leads))])
        at = lambda name: F.get(F.array(*[F.col(f"{name}{i}") for i in range(len(leads))]), F.col("_lead"))
        large = stats.filter(F.col("_n") > hot_rows).withColumn("_lead", ready).filter("_lead IS NOT NULL")
        large = settle(large.select(
            *[F.col(k).alias(f"_c_{k}") for k in keys], "_lead", at("_low").alias("_low"),
            ((at("_high") - at("_low")) / F.ceil(2 * F.col("_n") / hot_rows)).alias("_width")).filter("_width > 0"))
        if large.isEmpty():
            return pieces, level > 0
        side = F.broadcast(large) if stored_bytes(large) <= BROADCAST_BYTES else large
        value = F.get(F.array(*leads), F.col("_lead"))
        place = F.when(value.isNull(), -1).otherwise(F.floor((value - F.col("_low")) / F.col("_width")))
        longer = F.when(F.col("_lead").isNull(), F.col("_piece")).otherwise(F.concat("_piece", F.array(place.cast("bigint"))))
        pieces = pieces.join(side, _same_keys(keys, "_c_"), "left").select(*df.columns, longer.alias("_piece"))
    return pieces, bool(leads)


def exact_rank(df: DataFrame, part: Sequence[str], order: Sequence[str], out: str = "rn",
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """`row_number()` per `part` ordered by `order`, safe for hot parts and for no part at all.

    `order` should be unique within a part. Parts with at most `hot_rows` rows keep the
    plain window.
    """
    pieces, any_hot = with_pieces(df, part, order, hot_rows)
    if not any_hot:
        # Without a part this is one task, of at most `hot_rows` rows.
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("bigint"))
    keys = [*part, "_piece"]
    # Only parts with several pieces need offsets; a part has rows / hot_rows pieces or twice as many.
    totals, before = pieces.filter(F.size("_piece") > 0), Window.partitionBy(*part).orderBy("_piece")
    local = pieces.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    offsets = totals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(c).alias(f"_o_{c}") for c in keys],
        F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
    )
    joined = local.join(offsets, _same_keys(keys, "_o_"), "left")
    return joined.select(*df.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(out))


def running_totals(df: DataFrame, order: str, values: dict[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running sums of `values` (column -> output name) along a unique `order`."""
    keys = ["_piece"]
    pieces, _ = with_pieces(df, [], [order], hot_rows)
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = pieces.select("*", *[F.sum(c).over(inside).alias(f"_l_{o}") for c, o in values.items()])
    totals = pieces.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{o}") for c, o in values.items()])
    # One row per piece meets in this window.
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.sum(f"_t_{o}").over(before).alias(f"_b_{o}") for o in values.values()])
    joined = local.join(offsets, keys, "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{o}") + F.coalesce(F.col(f"_b_{o}"), F.lit(0))).alias(o) for o in values.values()],
    )


def above_threshold(items: DataFrame, needs: DataFrame, part: Sequence[str], level: str, need: str,
                    payload: Column, out: str, total: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """For every distinct (part, need): the least `payload` over items with level > need.

    With `total` the payload is summed instead. Replaces an items x needs inequality
    join: both sides are merged, cut along the level and scanned once, so the work
    grows with the sum of both sides.
    """
    merge = F.sum if total else F.min
    blank = [F.col(c) for c in part]
    left = items.groupBy(*part, F.col(level).cast("double").alias("_level")).agg(merge(payload).alias("_pay"))
    right = needs.select(*blank, F.col(need).cast("double").alias("_level")).distinct()
    both = left.select(*blank, "_level", "_pay", F.lit(1).alias("_item")).unionByName(
        right.select(*blank, "_level", F.lit(0).alias("_item")), allowMissingColumns=True
    )
    # Read four times below: written once, as one row per distinct level and part.
    pieces, _ = with_pieces(settle(both), part, ["_level"], hot_rows)
    keys = [*part, "_piece"]
    inside = Window.partitionBy(*keys).orderBy(F.desc("_level"), "_item").rowsBetween(Window.unboundedPreceding, 0)
    local = pieces.withColumn("_near", merge("_pay").over(inside)).filter("_item = 0")
    # What lies in higher pieces: a suffix over the pieces of each part that hold anything.
    per_piece = pieces.groupBy(*keys).agg(merge("_pay").alias("_piece_pay"))
    after = Window.partitionBy(*part).orderBy(F.desc("_piece"))
    far = per_piece.select(*keys, merge("_piece_pay").over(after.rowsBetween(Window.unboundedPreceding, -1)).alias("_far"))
    joined = local.join(far, keys, "left")
    if total:
        best = F.coalesce("_near", F.lit(0)) + F.coalesce("_far", F.lit(0))
    else:
        best = F.least("_near", "_far")
    return joined.select(*blank, F.col("_level").alias(need), best.alias(out))


def _same_keys(keys: Sequence[str], prefix: str) -> Column:
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"{prefix}{key}"))
    return match
