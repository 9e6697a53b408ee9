"""Node inventory and node metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.numbers import round_2dp

# Averaging span, the namespace whose containers are ours, bytes per KiB,
# and the mark of worker nodes.
SPAN = "5 minutes"
STEP = "1 minute"
OWN_NAMESPACE = "kubeflow"
BYTES_PER_KB = 1024
WORKER_MARK = "agent"
# Fractions of a byte are summed as whole numbers of this part of it.
FRACTION = 1 << 32


def free_memory_avg(metrics: DataFrame, span: str = SPAN, step: str = STEP) -> DataFrame:
    """Mean gauge per node over a sliding span, in whole KiB. Works on a stream as well."""
    return (
        metrics.groupBy("node_id", F.window("ts", span, step).alias("w"))
        .agg(F.avg("value").alias("mean"))
        .select("node_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                F.round(F.col("mean") / BYTES_PER_KB, 0).cast("bigint").alias("free_kb"))
    )


def own_containers(metrics: DataFrame, namespace: str = OWN_NAMESPACE) -> DataFrame:
    return metrics.filter((F.col("namespace") == namespace) & (F.col("container") != ""))


def namespace_memory_avg(metrics: DataFrame, namespace: str = OWN_NAMESPACE, span: str = SPAN, step: str = STEP) -> DataFrame:
    """Sum over containers at each instant, then the mean of those sums over a sliding span.

    Sums are those of whole numbers and of fractions, rounded once at the end: doubles summed in another order
    differ in the last bit, which tells at half a KiB.
    """
    whole = F.floor("value")
    part = ((F.col("value") - whole) * FRACTION).cast("bigint")
    sums = [F.sum("whole").alias("whole"), F.sum("part").alias("part")]
    readings = own_containers(metrics, namespace).select("node_id", "ts", whole.cast("decimal(19,0)").alias("whole"), part.alias("part"))
    at_instant = readings.groupBy("node_id", "ts").agg(*sums)
    mean = F.try_divide(F.col("whole").cast("double") + F.col("part") / F.lit(float(FRACTION)), "n")
    return (
        at_instant.groupBy("node_id", F.window("ts", span, step).alias("w"))
        .agg(*sums, F.count("whole").alias("n"))
        .select("node_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                F.round(mean / BYTES_PER_KB, 0).cast("bigint").alias("used_kb"))
    )


def memory_usage_ratio(nodes: DataFrame, free: DataFrame, own: DataFrame) -> DataFrame:
    """(total - free - own) / total per node, a missing metric counting 0."""
    joined = nodes.join(free.select("node_id", "free_kb"), "node_id", "left").join(
        own.select("node_id", "used_kb"), "node_id", "left"
    )
    total = F.col("memory_kb")
    rest = total - F.coalesce("free_kb", F.lit(0)) - F.coalesce("used_kb", F.lit(0))
    ratio = F.try_divide(rest.cast("double"), total.cast("double"))
    return joined.select("node_id", ratio.alias("memory_usage"), round_2dp(ratio).alias("memory_usage_2dp"))


def latest_window(averages: DataFrame, value: str) -> DataFrame:
    """The most recent window of every node."""
    return averages.groupBy("node_id").agg(F.max_by(value, "window_end").alias(value))


def is_ready(conditions: Column) -> Column:
    """True when a Ready condition has status 'True'."""
    return F.coalesce(F.exists(conditions, lambda c: (c["type"] == "Ready") & (c["status"] == "True")), F.lit(False))


def ready_workers(nodes: DataFrame) -> DataFrame:
    """Worker nodes (their arguments mention an agent) that are Ready."""
    return nodes.filter(F.col("node_args").contains(WORKER_MARK) & is_ready(F.col("conditions")))


def parse_quantity(text: Column) -> Column:
    """The number of a quantity with a two-letter unit: '16384Ki' -> 16384; NULL for any other text."""
    return F.regexp_extract(text, r"^(\d+)[A-Za-z]{2}$", 1).try_cast("bigint")


def node_filter_sort(nodes: DataFrame, filters: Mapping[str, object] | None = None, sort: Sequence[str] = (),
                     descending: bool = False) -> DataFrame:
    """Keeps nodes whose columns equal a value or are in a list; sorts by several columns."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k).eqNullSafe(F.lit(v))
             for k, v in (filters or {}).items()]
    kept = nodes.filter(reduce(lambda a, b: a & b, tests)) if tests else nodes
    if not sort:
        return kept
    return kept.orderBy(*[F.desc(c) if descending else F.asc(c) for c in sort])


def node_platform(accelerator: Column, architecture: Column) -> Column:
    """The accelerator, or the architecture when there is none."""
    return F.when(accelerator != "none", accelerator).otherwise(architecture)
