"""Run-state telemetry over batch tables.

"Last wins" is always an aggregation over an explicit order, never a file or partition
order, and combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.numbers import round_2dp, seconds_2dp
from tallyforge.functions.ordered import exact_rank, running_totals
from tallyforge.functions.timing import duration_or_null, finished_or_null, micros, micros_between, seconds_between
from tallyforge.session import settle

# States of a run that has ended.
TERMINAL_STATES = ["SUCCEEDED", "FAILED"]
SUCCEEDED = "SUCCEEDED"


def normalize_times(df: DataFrame, start: str, end: str) -> DataFrame:
    """`end` at or before the epoch means unfinished: NULL. Adds duration (2 dp), NULL when negative."""
    us = micros_between(F.col(start), F.col(end))
    duration = F.when(us >= 0, seconds_2dp(us))
    return df.withColumn("duration", duration).withColumn(end, finished_or_null(F.col(end)))


def normalize_run(runs: DataFrame) -> DataFrame:
    return normalize_times(runs, "scheduled_at", "finished_at")


def normalize_task(task_details: DataFrame, components: DataFrame) -> DataFrame:
    """Task reports of known components (pipeline_id, component) only, times normalised."""
    known = components.select("pipeline_id", "component")
    return normalize_times(task_details.join(known, ["pipeline_id", "component"], "left_semi"), "start_time", "end_time")


def latest_by(updates: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: the values of its last update."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return updates.groupBy(key).agg(last).select(key, *[F.col(f"_last.{v}").alias(v) for v in values])


def latest_run_by_id(updates: DataFrame) -> DataFrame:
    """Rows (run_id, state, updated_at) from updates (run_id, state, updated_at, seq)."""
    return latest_by(updates, "run_id", ["updated_at", "seq"], ["state", "updated_at"])


def normalized_name(name: Column) -> Column:
    return F.translate(F.lower(name), "_", "-")


def prefix_match_run(pipelines: DataFrame, runs: DataFrame) -> DataFrame:
    """Pipelines (pipeline_id, name) with the last run whose display name starts with their name.

    A prefix test would need a nested loop. Names have few distinct lengths, so every
    display name is cut at those lengths and joined by equality, which is the same test.
    """
    named = pipelines.withColumn("_name", normalized_name(F.col("name")))
    names = named.select("_name").distinct()
    # One entry per distinct name length.
    lengths = names.agg(F.collect_set(F.length("_name")).alias("l")).scalar()
    last = runs.groupBy("display_name").agg(F.max_by("run_id", F.struct("seq", "run_id")).alias("run_id"), F.max("seq").alias("seq"))
    cut = last.withColumn("_length", F.explode(lengths)).filter(F.length("display_name") >= F.col("_length"))
    prefixes = (
        cut.select(F.expr("substring(display_name, 1, _length)").alias("_name"), "run_id", "seq")
        .groupBy("_name")
        .agg(F.max_by("run_id", F.struct("seq", "run_id")).alias("run_id"))
    )
    matched = names.join(prefixes, "_name")
    return named.join(matched, "_name", "left").select("pipeline_id", "name", "run_id")


def submission_windows(runs: DataFrame, every: str) -> DataFrame:
    """Adds the window a run was submitted in and its number among non-empty windows; NULL for a run without a submission time."""
    start = F.window("submitted_at", every).getField("start")
    placed = runs.filter("submitted_at IS NOT NULL").withColumn("window_start", start)
    windows = settle(placed.select("window_start").distinct().withColumn("_us", micros(F.col("window_start"))))
    numbered = exact_rank(windows, [], ["_us"], "time_window").drop("_us")
    # `window` itself drops rows without a time; they are in no window but stay in the result.
    return placed.join(numbered, "window_start", "left").unionByName(runs.filter("submitted_at IS NULL"), allowMissingColumns=True)


def state_changes(runs: DataFrame) -> DataFrame:
    """Rows (ts, running, waiting) of +1/-1 at submission, start and finish, summed per instant."""
    def change(ts: str, running: int, waiting: int) -> Column:
        return F.struct(F.col(ts).alias("ts"), F.lit(running).alias("running"), F.lit(waiting).alias("waiting"))

    changes = F.array(change("submitted_at", 0, 1), change("scheduled_at", 1, -1), change("finished_at", -1, 0))
    return (
        runs.select(F.inline(changes)).filter("ts IS NOT NULL").groupBy("ts")
        .agg(F.sum("running").alias("d_running"), F.sum("waiting").alias("d_waiting"))
    )


def running_waiting_counts(runs: DataFrame) -> DataFrame:
    """Number of running and waiting runs after each change."""
    changes = settle(state_changes(runs).withColumn("_us", micros(F.col("ts"))))
    totals = running_totals(changes, "_us", {"d_running": "running", "d_waiting": "waiting"})
    return totals.select("ts", "running", "waiting")


def terminal_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("state").isin(TERMINAL_STATES))


def node_release_times(tasks: DataFrame) -> DataFrame:
    """When a pipeline frees a node: the end of its last task there, once all of them succeeded."""
    per_node = tasks.groupBy("pipeline_id", "node_id").agg(
        F.max("end_time").alias("released_at"), F.bool_and(F.coalesce(F.col("state") == SUCCEEDED, F.lit(False))).alias("_all")
    )
    return per_node.filter("_all").drop("_all")


def active_assignments(assignments: DataFrame, tasks: DataFrame) -> DataFrame:
    """Assignments (pipeline_id, component, node_id) whose task has not succeeded."""
    done = tasks.filter(F.col("state") == SUCCEEDED).select("pipeline_id", "component")
    return assignments.join(done, ["pipeline_id", "component"], "left_anti")


def still_needed_nodes(nodes_of: DataFrame, active: DataFrame) -> DataFrame:
    """(pipeline_id, node_id) pairs with at least one active task."""
    return nodes_of.join(active, ["pipeline_id", "node_id"], "left_semi")


def ready_pipelines(required: DataFrame, occupation: DataFrame) -> DataFrame:
    """Waiting pipelines whose required nodes (pipeline_id, node_id) are all free in the snapshot.

    Only busy nodes are joined, and a pipeline is dropped by one of them.
    """
    busy = occupation.filter(F.col("occupant").isNotNull()).select("node_id").distinct().withColumn("_busy", F.lit(True))
    marked = required.join(busy, "node_id", "left")
    free = marked.groupBy("pipeline_id").agg(F.bool_and(F.col("_busy").isNull()).alias("_free"))
    return free.filter("_free").select("pipeline_id")


def run_lookup(runs: DataFrame, key: str, value) -> DataFrame:
    """One run by id; no row when unknown. The filter reaches the scan."""
    return runs.filter(F.col(key) == F.lit(value))


def task_durations(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number and duration (mean, least, most) of finished tasks per type, node or platform."""
    timed = tasks.withColumn("_s", seconds_between(F.col("start_time"), F.col("end_time"))).filter("_s >= 0")
    return timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tasks"), F.avg("_s").alias("avg_s"), F.min("_s").alias("min_s"), F.max("_s").alias("max_s")
    )
