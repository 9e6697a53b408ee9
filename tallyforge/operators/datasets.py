"""Dataset registry, dataset sizes and table profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Bytes of one item of each array type.
ITEM_BYTES = {
    "bool": 1, "int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "int32": 4, "uint32": 4, "int64": 8, "uint64": 8,
    "float16": 2, "float32": 4, "float64": 8, "complex64": 8, "complex128": 16, "object": 8,
}
BYTES_PER_KB = 1024
# uint8 pixels become float64 values in memory.
IMAGE_GROWTH = 8
# Names of Spark types in a profile.
PROFILE_TYPES = {"bigint": "int64", "int": "int32", "double": "float64", "float": "float32", "string": "object",
                 "boolean": "bool", "smallint": "int16", "tinyint": "int8"}


def dataset_registry(spark: SparkSession, root: str) -> DataFrame:
    """One row per dataset below `root`: name, path, size_kb, modified_at; hidden names skipped.

    Reads the file listing only, never the content. A file directly below `root` is a
    dataset of its own.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(
        "path", "length", "modificationTime"
    )
    inner = F.substring_index("path", f"{base}/", -1)
    name = F.split_part(inner, F.lit("/"), F.lit(1))
    return (
        files.withColumn("name", name)
        .filter(~F.col("name").startswith("."))
        .groupBy("name")
        .agg(F.ceil(F.sum("length") / BYTES_PER_KB).alias("size_kb"), F.max("modificationTime").alias("modified_at"))
        .select("name", F.concat(F.lit(f"{base}/"), F.col("name")).alias("path"), "size_kb", "modified_at")
    )


def registry_refresh(registry: DataFrame, found: DataFrame) -> DataFrame:
    """Entries replaced by strictly newer ones; an equal time keeps the registered entry."""
    columns = ["path", "size_kb", "modified_at"]
    both = registry.select("name", *columns, F.lit(1).alias("_kept")).unionByName(
        found.select("name", *columns, F.lit(0).alias("_kept"))
    )
    last = F.max_by(F.struct(*columns), F.struct("modified_at", "_kept", "path", "size_kb")).alias("_last")
    return both.groupBy("name").agg(last).select("name", *[F.col(f"_last.{c}").alias(c) for c in columns])


def array_size_kb(n_samples: Column, data_types: Column) -> Column:
    """floor(samples x sum(item bytes x columns) / 1024) from a type histogram map; an unknown type is an error."""
    sizes = F.map_from_arrays(F.array(*[F.lit(k) for k in ITEM_BYTES]), F.array(*[F.lit(v) for v in ITEM_BYTES.values()]))

    def bytes_of(entry: Column) -> Column:
        known = F.element_at(sizes, entry["key"])
        return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown array type: "), entry["key"])).cast("int")) * entry["value"]

    sample = F.aggregate(F.map_entries(data_types), F.lit(0).cast("bigint"), lambda acc, e: acc + bytes_of(e))
    # Whole numbers all the way: a quotient of doubles is one too high beyond 2^53.
    return F.shiftright(n_samples.cast("bigint") * sample, int(math.log2(BYTES_PER_KB)))


def size_in_memory(datasets: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds size_kb: images by registry size (x 8 unless normalised), tables by `array_size_kb`.

    `datasets` has name, type, normalized, n_samples and data_types.
    """
    known = registry.select("name", F.col("size_kb").alias("_registry_kb"))
    growth = F.when(F.coalesce("normalized", F.lit(False)), 1).otherwise(IMAGE_GROWTH)
    size = F.when(F.col("type") == "image", F.col("_registry_kb") * growth).when(
        F.col("type") == "tabular", array_size_kb(F.col("n_samples"), F.col("data_types"))
    )
    return datasets.join(known, "name", "left").withColumn("size_kb", size).drop("_registry_kb")


def table_profile(df: DataFrame, label: str) -> DataFrame:
    """Rows, features, classes and the type histogram of a table: one row per type."""
    histogram: dict[str, int] = {}
    for field in df.schema.fields:
        kind = PROFILE_TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
        histogram[kind] = histogram.get(kind, 0) + 1
    counted = df.agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct(F.col(label)).alias("n_classes"))
    types = F.array(*[F.struct(F.lit(k).alias("data_type"), F.lit(v).alias("n_columns")) for k, v in histogram.items()])
    return counted.select("n_samples", F.lit(len(df.columns) - 1).alias("n_features"), "n_classes", F.inline(types))
