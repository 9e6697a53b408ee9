"""Readers and writers for tables, arrays, run logs and catalogs."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyforge.functions.timing import seconds_between
from tallyforge.sources import ranges, schemas

# Columns that stay inside the service and never reach a dump.
PRIVATE_RUN_COLUMNS = ["effort", "last_update", "time_window", "metadata"]


# --- tables ---------------------------------------------------------------------------

def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", header: bool = True,
             missing: str = "") -> DataFrame:
    """CSV with a declared schema; `header=False` takes the names from the schema."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("nullValue", missing)
    return reader.option("enforceSchema", not header).csv(path)


def read_arrays(spark: SparkSession, x_path: str, y_path: str) -> DataFrame:
    """Pixels and labels of two tables, matched on `idx` instead of on position."""
    x = spark.read.schema(schemas.ARRAYS_X).parquet(x_path)
    y = spark.read.schema(schemas.ARRAYS_Y).parquet(y_path)
    return x.join(y, "idx")


def read_npy(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """Array files as rows (folder, file, pos, values); values are flattened and keep their precision as doubles.

    A file is one row of Spark's binary source, which holds up to 2 GB and is right for many small
    files; `read_npy_ranges` reads files of any size in several tasks. Within a file rows leave in Arrow
    batches. Shards of x and y with equal names match on (folder, pos).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                data = np.load(io.BytesIO(content), allow_pickle=False)
                flat = data.reshape(data.shape[0], -1)
                folder, short = name.rsplit("/", 2)[-2:]
                for start in range(0, len(flat), 4096):
                    part = flat[start:start + 4096].astype("float64")
                    yield pd.DataFrame({"folder": folder, "file": short, "pos": np.arange(start, start + len(part)), "values": list(part)})

    return files.mapInPandas(rows, "folder string, file string, pos bigint, values array<double>")


def read_npy_ranges(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """The rows of `read_npy`, a file of any size cut into ranges that tasks share."""
    place = F.split("file", "/")
    return ranges.npy_rows(spark, path, pattern).select(F.element_at(place, -2).alias("folder"), F.element_at(place, -1).alias("file"), "pos", "values")


def write_npy(df: DataFrame, path: str, shard: str, order: str, values: str) -> None:
    """One array file per value of `shard`, in a folder `shard=..`; rows by `order`. The caller bounds the rows of a shard."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, np.stack(pdf.sort_values("_order")["_values"].to_numpy()))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "value": [out.getvalue()]})

    rows = df.select(F.col(shard).cast("bigint").alias("shard"), F.col(order).alias("_order"), F.col(values).alias("_values"))
    packed = rows.groupBy("shard").applyInPandas(pack, "shard bigint, value binary")
    # The text writer puts the bytes down as they are; the line end after an array is not read.
    packed.select("shard", F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).partitionBy("shard").text(path)


def write_artifacts(df: DataFrame, path: str, split: str = "split") -> None:
    """Train and test rows in one table, one folder per part; x and y stay together."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


# --- run logs -------------------------------------------------------------------------

def read_run_dumps(spark: SparkSession, root: str, multi_line: bool = True,
                   layout: str = r"/(?:strategy=)?([^/]+)/(?:seed=)?([^/]+)/[^/]+$", by_ranges: bool = False) -> DataFrame:
    """Every dump below `root` in one table; strategy and seed come from the path.

    `multi_line` is for files that hold one JSON array, each read by one task; `by_ranges` cuts
    such files at object borders, so that a large one is read by many. Dumps written by this
    library are one object per line and split across tasks.
    """
    if by_ranges:
        runs = ranges.read_json_elements(spark, root, schemas.RUN_DUMP)
    else:
        reader = spark.read.schema(schemas.RUN_DUMP).option("multiLine", multi_line).option("recursiveFileLookup", True)
        runs = reader.json(root).withColumn("_path", F.col("_metadata.file_path"))
    times = {c: F.col(c).cast("timestamp") for c in ("submitted_at", "scheduled_at", "finished_at")}
    return runs.withColumns({
        "strategy": F.regexp_extract("_path", layout, 1), "seed": F.regexp_extract("_path", layout, 2), **times,
    }).drop("_path")


def read_external_runs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Documents {"runs": [..]} as one row per run.

    name = first word of the display name with `-` as `_`; duration keeps its fraction.
    """
    documents = spark.read.schema(schemas.KFP_RUNS).option("multiLine", multi_line).json(path)
    runs = documents.select(F.inline("runs"))
    first_word = F.get(F.split(F.trim("display_name"), r"\s+"), F.lit(0))
    times = {c: F.col(c).cast("timestamp") for c in ("created_at", "scheduled_at", "finished_at")}
    return runs.withColumns({"name": F.translate(first_word, "-", "_"), **times}).withColumn(
        "duration", seconds_between(F.col("scheduled_at"), F.col("finished_at"))
    )


def external_task_details(runs: DataFrame) -> DataFrame:
    """One row per reported task of an external run."""
    details = runs.select("run_id", F.inline("run_details.task_details"))
    return details.select("run_id", F.col("display_name").alias("component"), "state",
                          F.col("start_time").cast("timestamp").alias("start_time"),
                          F.col("end_time").cast("timestamp").alias("end_time"))


def explode_components(runs: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Component map -> one row per task."""
    return runs.select(*keys, F.explode("components").alias("component", "_task")).select(*keys, "component", "_task.*")


def text_time(ts: Column) -> Column:
    """`2025-01-02 03:04:05.678901+00:00`, as dumps write times."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def write_run_dump(runs: DataFrame, path: str, parts: tuple[str, ...] = ("strategy", "seed")) -> None:
    """All runs as JSON, one folder per strategy and seed; private columns are dropped."""
    public = runs.drop(*PRIVATE_RUN_COLUMNS)
    public.write.mode("overwrite").partitionBy(*parts).json(path)


# --- counter log ----------------------------------------------------------------------

def read_counter_log(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.COUNTER_LOG)


def append_counter_log(rows: DataFrame, path: str) -> None:
    """Adds rows to the log; earlier files are never rewritten."""
    columns = [field.split() for field in schemas.COUNTER_LOG.split(", ")]
    rows.select(*[F.col(n).cast(kind).alias(n) for n, kind in columns]).write.mode("append").option("header", True).csv(path)


# --- catalog --------------------------------------------------------------------------

def read_catalog(spark: SparkSession, path: str, multi_line: bool = True, by_ranges: bool = False) -> DataFrame:
    """Pipeline metadata files with the union schema of all their variants; `by_ranges` as for run dumps."""
    if by_ranges:
        return ranges.read_json_elements(spark, path, schemas.CATALOG).drop("_path")
    reader = spark.read.schema(schemas.CATALOG).option("multiLine", multi_line).option("recursiveFileLookup", True)
    return reader.json(path)
