"""Quantiles kept up to date by mergeable sketches, one per part of a table and column.

A part is what arrives together (a day, a file, a partition). Its sketch is made once, in one aggregation over all
columns, and written; an append reads and sketches the new parts alone. Quantiles come from merging the sketches of all
parts, kilobytes each, so no row is read again. With `k` marks a merged sketch misses a rank by at most
`rank_error(k)` of the rows at 99 % confidence, whatever the number of parts.

NULL is skipped; a column without values has NULL quantiles. A part that is in the table already is left as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.operators.prep import quoted

MARKS = 4096
_TABLE = "part string, column string, n long, sketch binary"


def rank_error(k: int = MARKS) -> float:
    """The rank error of these sketches, as their authors give it."""
    return 2.296 / k ** 0.9723


def part_sketches(df: DataFrame, part: Column, columns: Sequence[str], k: int = MARKS) -> DataFrame:
    """part, column, n and sketch: one row per part and column, from one pass."""
    values = df.select(part.cast("string").alias("part"), *[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    made = values.groupBy("part").agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))],
                                      *[F.kll_sketch_agg_double(f"c{i}", k).alias(f"s{i}") for i in range(len(columns))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)])
    return made.select("part", F.inline(rows))


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _TABLE)
    return spark.read.schema(_TABLE).parquet(path)


def refresh_sketches(df: DataFrame, path: str, part: Column, columns: Sequence[str], k: int = MARKS) -> DataFrame:
    """Sketches the parts of `df` that the table at `path` doesn't have, adds them, and returns the whole table.

    Where `part` is a partition column of `df`, files of known parts aren't read.
    """
    known = stored_sketches(df.sparkSession, path).select("part").distinct()
    new = df.withColumn("_part", part.cast("string")).join(known.withColumnRenamed("part", "_part"), "_part", "left_anti")
    part_sketches(new, F.col("_part"), columns, k).write.mode("append").parquet(path)
    return stored_sketches(df.sparkSession, path)


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """Rows (column, prob, n, value) of all parts together."""
    held = sketches.filter("n > 0").groupBy("column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("s"))
    found = held.select("column", "n", F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("s", F.lit(float(p))).alias("value")) for p in probs])).alias("q"))
    return found.select("column", "q.prob", "n", "q.value")


def sketched_limits(sketches: DataFrame) -> dict[str, tuple[float, float]]:
    """{column: (q1 - 1.5 iqr, q3 + 1.5 iqr)} for `clip_to`; a column without values has no limits."""
    found: dict[str, dict[float, float]] = {}
    for row in sketched_quantiles(sketches).collect():
        found.setdefault(row["column"], {})[row["prob"]] = row["value"]
    return {c: (q[0.25] - 1.5 * (q[0.75] - q[0.25]), q[0.75] + 1.5 * (q[0.75] - q[0.25])) for c, q in found.items()}
