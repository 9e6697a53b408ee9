"""Artifact lineage and component names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# How argument kinds start.
PRODUCES = "Output"
CONSUMES = "Input"


def argument_role(kind: Column) -> Column:
    """`producer` for kinds that contain Output, `consumer` for kinds that start with Input, else `value`."""
    return (
        F.when(kind.contains(PRODUCES), "producer").when(kind.startswith(CONSUMES), "consumer").otherwise("value")
    )


def artifact_arg_filter(args: DataFrame) -> DataFrame:
    """Arguments that are artifacts, with their role."""
    return args.withColumn("role", argument_role(F.col("kind"))).filter("role <> 'value'")


def artifact_edges(args: DataFrame) -> DataFrame:
    """producer -> consumer rows per (pipeline, artifact); the last producer of a name wins.

    The producer side is one row per (pipeline, artifact) after a map-side combined
    `max_by`, so the join never multiplies rows.
    """
    roles = artifact_arg_filter(args)
    producers = (
        roles.filter("role = 'producer'")
        .groupBy("pipeline_id", "arg")
        .agg(F.max_by("component", F.struct("position", "component")).alias("producer"))
    )
    consumers = roles.filter("role = 'consumer'").select("pipeline_id", "arg", F.col("component").alias("consumer"))
    return consumers.join(producers, ["pipeline_id", "arg"]).select(
        "pipeline_id", F.col("arg").alias("artifact"), "producer", "consumer"
    )


def normalize_component(filename: Column) -> Column:
    """Lower case, underscores as hyphens, text up to the first dot."""
    return F.translate(F.lower(F.split_part(filename, F.lit("."), F.lit(1))), "_", "-")


def task_types(catalog: DataFrame, tasks: DataFrame) -> DataFrame:
    """Adds each task's phase from its pipeline's component map; an unlisted component has none."""
    maps = catalog.select("pipeline_id", "components_type")
    joined = tasks.join(maps, "pipeline_id", "left")
    return joined.withColumn("type", F.element_at("components_type", F.col("component"))).drop("components_type")
