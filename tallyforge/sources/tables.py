"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """`<folder>/<name>.parquet`, with columns and filters left to the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
