"""Registry of the corpus queries and helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers `fn(spark, folder)` under `key`; `oracle` is run by DuckDB on the same tables."""

    def keep(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query key: {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000, max_bytes: int = 8 << 20,
            weigh: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches out of tuples, closed after `size` rows or about `max_bytes` by `weigh`."""
    kept: list[tuple] = []
    held = 0
    for row in rows:
        kept.append(row)
        held += weigh(row) if weigh else 0
        if len(kept) >= size or held >= max_bytes:
            yield _batch(kept, schema)
            kept, held = [], 0
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def arrow_rows(stream: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Tuples out of Arrow batches, a slice at a time, so that no batch is held as Python objects whole."""
    for batch in stream:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(c.to_pylist() for c in part.columns))


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A new schema with the columns of `ddl` after those of `schema`."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """`df.mapInArrow(run, schema)` with batches of at most 4 MB, so that long texts don't add up to batches of any size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df.mapInArrow(run, schema)
