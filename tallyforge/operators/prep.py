"""Feature preparation, column by column and row by row.

Missing values are NULL throughout. Statistics are fitted in one pass over all columns
and enter the row expressions as constants, so no join is planned for them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyforge.functions.hashing import HASH_RANGE, hash32
from tallyforge.functions.ordered import HOT_ROWS, exact_rank
from tallyforge.session import BROADCAST_BYTES, bounded_broadcast, settle, stored_bytes

NUMERIC = (T.LongType, T.DoubleType)
TEXT = (T.StringType,)
SPLIT_RANGES = 4096


def columns_of(df: DataFrame, kinds: tuple[type, ...]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


# --- missing values, duplicates -------------------------------------------------------

def sentinel_columns(df: DataFrame, sentinel: str = "?") -> DataFrame:
    """Which text columns hold the sentinel: one row per column, one pass over the data."""
    names = columns_of(df, TEXT)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, has_sentinel boolean")
    found = df.agg(*[F.coalesce(F.max(quoted(c) == sentinel), F.lit(False)).alias(f"s{i}") for i, c in enumerate(names)])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("has_sentinel")) for i, c in enumerate(names)]
    return found.select(F.inline(F.array(*pairs)))


def sentinel_to_null(df: DataFrame, sentinel: str = "?", columns: Sequence[str] | None = None) -> DataFrame:
    names = columns if columns is not None else columns_of(df, TEXT)
    return df.withColumns({c: F.nullif(quoted(c), F.lit(sentinel)) for c in names})


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row duplicates, NULL equal to NULL; copies are merged before the shuffle."""
    return df.dropDuplicates()


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


# --- quantiles and clipping -----------------------------------------------------------

def fit_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], margin: float = 1e-3,
                  piece_rows: int = 1_000_000) -> dict[str, list]:
    """Exact quantiles with linear interpolation, as {column: [value per prob]}.

    A sketch brackets each wanted rank. One aggregation counts what lies below and inside all
    brackets; a bracket that misses its rank is widened, one that holds more than `piece_rows` rows
    is narrowed by a sketch of its inside, until every bracket is right and small or holds a single
    value. Only rows inside a bracket are then counted by value and ranked. A finer `margin` makes larger sketches,
    which one task merges, one per part of the table.
    """
    values = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    accuracy = int(10 / margin)
    edges = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in probs for d in (-margin, margin)])
    first = values.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))],
                       *[F.percentile_approx(f"c{i}", edges, F.lit(accuracy)).alias(f"e{i}") for i in range(len(columns))],
                       *[f(f"c{i}").alias(f"{k}{i}") for i in range(len(columns)) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    fitted: dict[str, list] = {c: [None] * len(probs) for c in columns}
    brackets: dict[tuple[int, int], tuple[float, float]] = {}
    wanted: dict[tuple[int, int], tuple[int, int, float]] = {}
    for i in range(len(columns)):
        for j, p in enumerate(probs):
            if first[f"n{i}"]:
                position = (first[f"n{i}"] - 1) * p
                wanted[i, j] = math.floor(position), math.ceil(position), position - math.floor(position)
                brackets[i, j] = first[f"e{i}"][2 * j], first[f"e{i}"][2 * j + 1]
    below: dict[tuple[int, int], int] = {}
    open_ones = list(brackets)
    while open_ones:
        asked = []
        for i, j in open_ones:
            value, (low, high) = F.col(f"c{i}"), brackets[i, j]
            inside = (value >= F.lit(low)) & (value <= F.lit(high))
            asked += [F.count_if(value < F.lit(low)).alias(f"b{i}_{j}"), F.count_if(inside).alias(f"i{i}_{j}")]
            if first[f"n{i}"] > piece_rows:
                asked.append(F.percentile_approx(F.when(inside, value), F.array(*[F.lit(k / 64) for k in range(65)]), F.lit(6400)).alias(f"s{i}_{j}"))
        counted = values.agg(*asked).first()
        again = []
        for i, j in open_ones:
            (a, b, _), (low, high) = wanted[i, j], brackets[i, j]
            under, held = counted[f"b{i}_{j}"], counted[f"i{i}_{j}"]
            if a < under or b >= under + held:
                brackets[i, j] = (first[f"lo{i}"] if a < under else low, first[f"hi{i}"] if b >= under + held else high)
                again.append((i, j))
                continue
            below[i, j] = under
            if held > piece_rows and low < high:
                # The marks cut the inside into 64 parts; the one with the rank, and its neighbours, hold a twentieth of it.
                marks = counted[f"s{i}_{j}"]
                k = int(64 * (a - under) / held)
                narrow = (marks[max(0, k - 1)], marks[min(64, k + 2)])
                if narrow != (low, high):
                    brackets[i, j] = narrow
                    again.append((i, j))
        open_ones = again
    if not wanted:
        return fitted
    keys = list(wanted)
    pieces = [F.when((F.col(f"c{i}") >= F.lit(brackets[i, j][0])) & (F.col(f"c{i}") <= F.lit(brackets[i, j][1])),
                     F.struct(F.lit(place).alias("place"), F.col(f"c{i}").alias("value"))) for place, (i, j) in enumerate(keys)]
    inside = (values.select(F.explode(F.filter(F.array(*pieces), lambda x: x.isNotNull())).alias("p"))
              .groupBy("p.place", "p.value").agg(F.count(F.lit(1)).alias("n")))
    # Brackets hold at most `piece_rows` rows, or few values that are repeated.
    order = Window.partitionBy("place").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.get(F.array(*[F.array(F.lit(wanted[k][0] - below[k]), F.lit(wanted[k][1] - below[k])) for k in keys]), F.col("place"))
    hits = inside.withColumn("upto", F.sum("n").over(order)).filter(
        F.exists(ends, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
    # At most two rows per column and probability.
    found: dict[int, list] = {}
    for hit in hits.collect():
        found.setdefault(hit["place"], []).append((hit["upto"] - hit["n"], hit["upto"], hit["value"]))
    for place, (i, j) in enumerate(keys):
        a, b, share = wanted[i, j]
        low, high = (next(v for x, y, v in found[place] if x <= r - below[i, j] < y) for r in (a, b))
        fitted[columns[i]][j] = low + (high - low) * share
    return fitted


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """Exact quantiles: rows (column, prob, value)."""
    fitted = fit_quantiles(df, columns, probs)
    rows = [(c, float(p), v) for c in columns for p, v in zip(probs, fitted[c])]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def quantiles_sketch(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.75),
                     accuracy: int = 100_000) -> DataFrame:
    """Approximate quantiles of all columns in one aggregation, rank error n / accuracy."""
    marks = F.array(*[F.lit(p) for p in probs])
    fitted = df.agg(*[F.percentile_approx(quoted(c).cast("double"), marks, F.lit(accuracy)).alias(f"q{i}")
                      for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(p).alias("prob"), F.get(F.col(f"q{i}"), F.lit(j)).alias("value"))
            for i, c in enumerate(columns) for j, p in enumerate(probs)]
    return fitted.select(F.inline(F.array(*rows)))


def iqr_limits(df: DataFrame, columns: Sequence[str], sketch: bool = False) -> dict[str, tuple[float, float]]:
    """{column: (q1 - 1.5 iqr, q3 + 1.5 iqr)}; a column without values has no limits."""
    if sketch:
        rows = quantiles_sketch(df, columns, (0.25, 0.75)).collect()
        fitted = {c: [next(r["value"] for r in rows if r["column"] == c and r["prob"] == p) for p in (0.25, 0.75)] for c in columns}
    else:
        fitted = fit_quantiles(df, columns, (0.25, 0.75))
    return {c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, q3) in fitted.items() if q1 is not None}


def iqr_clip(df: DataFrame, columns: Sequence[str] | None = None, sketch: bool = False) -> DataFrame:
    """Clips every numeric column to its own limits; NULL stays NULL.

    The limits are fitted at once.
    """
    names = list(columns) if columns is not None else columns_of(df, NUMERIC)
    if not names:
        return df
    return clip_to(df, iqr_limits(df, names, sketch))


def clip_to(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Clips the columns that have limits, in one projection with constants."""

    def clipped(name: str) -> Column:
        value, (low, high) = quoted(name).cast("double"), limits[name]
        return F.when(value < F.lit(low), F.lit(low)).when(value > F.lit(high), F.lit(high)).otherwise(value)

    return df.select(*[clipped(c).alias(c) if c in limits else quoted(c) for c in df.columns])


# --- column selection and values ------------------------------------------------------

def select_by_dtype(df: DataFrame, kinds: tuple[type, ...], keep: Sequence[str] = ()) -> DataFrame:
    chosen = set(columns_of(df, kinds)) | set(keep)
    return df.select(*[quoted(c) for c in df.columns if c in chosen])


def map_values(df: DataFrame, column: str, mapping: Mapping[str, str], out: str | None = None) -> DataFrame:
    """Dictionary lookup; keys match exactly, unmapped values become NULL."""
    literal = F.from_json(F.lit(json.dumps(dict(mapping))), "map<string,string>")
    return df.withColumn(out or column, F.element_at(literal, quoted(column)))


def map_values_table(df: DataFrame, column: str, mapping: DataFrame, out: str | None = None,
                     max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The same for a dictionary held as a table (key, value) of any size."""
    side = bounded_broadcast(mapping.select(F.col("key").alias("_key"), F.col("value").alias("_mapped")), max_bytes)
    joined = df.join(side, quoted(column) == F.col("_key"), "left").drop("_key")
    target = out or column
    return joined.withColumn(target, F.col("_mapped")).drop("_mapped")


def collapse_to_other(df: DataFrame, column: str, keep: str, other: str = "Other") -> DataFrame:
    """`keep` stays, everything else (NULL too) becomes `other`."""
    return df.withColumn(column, F.when(quoted(column) == keep, F.lit(keep)).otherwise(F.lit(other)))


def label_classes(df: DataFrame, columns: Sequence[str]) -> list[tuple[list[int], DataFrame]]:
    """Distinct values in sorted order, per type of column: (column numbers, rows (column, value, code)) with codes 0..k-1.

    Columns of one type share one pass over the data, one rank and one written table, however many they are.
    """
    by_type: dict[str, list[int]] = {}
    for i, name in enumerate(columns):
        by_type.setdefault(df.schema[name].dataType.simpleString(), []).append(i)
    found = []
    for numbers in by_type.values():
        pairs = F.array(*[F.struct(F.lit(i).alias("column"), quoted(columns[i]).alias("value")) for i in numbers])
        classes = settle(df.select(F.explode(pairs).alias("p")).select("p.column", "p.value").filter("value IS NOT NULL").distinct())
        ranked = exact_rank(classes, ["column"], ["value"], "_rank")
        found.append((numbers, ranked.select("column", "value", (F.col("_rank") - 1).alias("code"))))
    return found


def label_encode(df: DataFrame, columns: Sequence[str], max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """Replaces each column by its class code; NULL is the class after the last.

    The class list of all columns is broadcast while its files are small; beyond
    `max_broadcast` bytes the columns are joined by shuffle instead.
    """
    codes: dict[str, Column] = {}
    joined = df
    for numbers, classes in label_classes(df, columns):
        side = settle(classes)
        small = stored_bytes(side) <= max_broadcast
        sizes = {r["column"]: r["n"] for r in side.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        for i in numbers:
            own = side.filter(F.col("column") == i).select(F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}"))
            joined = joined.join(F.broadcast(own) if small else own, quoted(columns[i]) == F.col(f"_value{i}"), "left")
            codes[columns[i]] = F.coalesce(F.col(f"_code{i}"), F.lit(sizes.get(i, 0)).cast("bigint"))
    return joined.select(*[codes[c].alias(c) if c in codes else quoted(c) for c in df.columns])


def binarize_equals(df: DataFrame, column: str, zero_value: str) -> DataFrame:
    """0 for `zero_value`, 1 for anything else."""
    return df.withColumn(column, F.when(quoted(column) == zero_value, 0).otherwise(1))


def binarize_threshold(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """1 from the threshold up, 0 below it and for NULL."""
    return df.withColumn(column, F.when(quoted(column) >= threshold, 1).otherwise(0))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    gone = set(names)
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def features_target(df: DataFrame, target: str, keep: Sequence[str] = (), features: Sequence[str] | None = None) -> DataFrame:
    """(keep.., features array<double>, label): x and y stay in one row."""
    names = list(features) if features is not None else [c for c in df.columns if c != target and c not in keep]
    array = F.array(*[quoted(c).cast("double") for c in names])
    return df.select(*[quoted(c) for c in keep], array.alias("features"), quoted(target).alias("label"))


# --- splits ---------------------------------------------------------------------------

def random_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split = train | test from a hash of the row key: stable under any partitioning, no shuffle."""
    limit = int(round(test_share * HASH_RANGE))
    return df.withColumn("split", F.when(hash32(quoted(key), F.lit(seed)) < limit, "test").otherwise("train"))


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """ceil(share * n) rows of every class go to test, chosen by hash order of the key.

    Hash ranges are counted per class first. A range wholly before or after the class's
    limit decides its rows where they are; only the one range that holds the limit is
    ranked, so nearly all rows are neither shuffled nor sorted. Copies of a key are told
    apart by a row number that is written down with them.
    """
    names = df.columns
    hashed = df.withColumn("_h1", hash32(quoted(key), F.lit(seed)))
    hashed = hashed.withColumn("_range", F.floor(F.col("_h1") / (HASH_RANGE // SPLIT_RANGES)))
    sizes = hashed.groupBy(quoted(label).alias("_class"), "_range").agg(F.count(F.lit(1)).alias("_n"))
    # SPLIT_RANGES rows per class meet in these windows.
    upto = Window.partitionBy("_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    limits = sizes.withColumns({
        "_end": F.sum("_n").over(upto),
        "_tests": F.ceil(F.sum("_n").over(Window.partitionBy("_class")) * F.lit(test_share)),
    }).filter((F.col("_tests") > F.col("_end") - F.col("_n")) & (F.col("_tests") <= F.col("_end")))
    limits = bounded_broadcast(limits.select(
        "_class", F.col("_range").alias("_limit"), (F.col("_tests") - (F.col("_end") - F.col("_n"))).alias("_left")))
    placed = hashed.join(limits, quoted(label).eqNullSafe(F.col("_class")), "left")
    on_limit = F.coalesce(F.col("_range") == F.col("_limit"), F.lit(False))
    clear = placed.filter(~on_limit).withColumn(
        "split", F.when(F.col("_range") < F.col("_limit"), "test").otherwise("train"))
    edge = settle(placed.filter(on_limit).withColumns({
        "_h2": hash32(quoted(key), F.lit(seed + 1)), "_copy": F.monotonically_increasing_id()}))
    ranked = exact_rank(edge, ["_class"], ["_h1", "_h2", key, "_copy"], "_rank", hot_rows)
    decided = ranked.withColumn("split", F.when(F.col("_rank") <= F.col("_left"), "test").otherwise("train"))
    keep = [*[quoted(c) for c in names], F.col("split")]
    return clear.select(*keep).unionByName(decided.select(*keep))


# --- scaling --------------------------------------------------------------------------

def standard_scale(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """(x - mean) / spread, fitted on the rows of `fit_on` (the train part), applied to all."""
    source = df if fit_on is None else df.filter(fit_on)
    row = source.agg(*[f(quoted(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(columns)
                       for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if columns else None
    # Constants keep the projection short: searching a map for every value, or a subquery per value, made it too long to be compiled.
    scaled = {c: (quoted(c) - F.lit(row[f"m{i}"]).cast("double")) / F.lit(1.0 if row[f"s{i}"] == 0 else row[f"s{i}"]).cast("double") for i, c in enumerate(columns)}
    return df.select(*[scaled[c].alias(c) if c in scaled else quoted(c) for c in df.columns])


# --- arrays ---------------------------------------------------------------------------

def pixel_normalize(values: Column, top: float = 255.0) -> Column:
    return F.transform(values, lambda x: x.cast("double") / F.lit(top))


def reshape_array(values: Column, shape: Sequence[int]) -> Column:
    """A flat array as nested arrays of the given shape; a wrong size is an error."""
    size = reduce(lambda a, b: a * b, shape, 1)
    message = F.concat(F.lit(f"expected {size} values, got "), F.size(values).cast("string"))
    flat = F.when(F.size(values) == size, values).otherwise(F.raise_error(message))
    return _nest(flat, list(shape))


def _nest(flat: Column, shape: list[int]) -> Column:
    if len(shape) == 1:
        return flat
    step = reduce(lambda a, b: a * b, shape[1:], 1)
    starts = F.sequence(F.lit(0), F.lit(shape[0] - 1))
    return F.transform(starts, lambda i: _nest(F.slice(flat, i * step + 1, F.lit(step)), shape[1:]))


def flatten_array(values: Column, depth: int) -> Column:
    """Undoes `reshape_array` for `depth` dimensions."""
    for _ in range(depth - 1):
        values = F.flatten(values)
    return values


# --- reports --------------------------------------------------------------------------

def shape_report(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each named stage."""
    counted = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("stage"), "n_rows", F.lit(len(df.columns)).alias("n_columns")) for name, df in stages.items()]
    return reduce(DataFrame.unionByName, counted)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(quoted(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
