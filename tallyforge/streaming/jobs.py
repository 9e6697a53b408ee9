"""Streaming forms of the run-state and node telemetry.

Each function maps a streaming DataFrame to a streaming DataFrame; `run_available`
drives one to a table. Windowed results use append mode behind a watermark, so state
is dropped as time passes and every row is written once. Rows later than the
watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.functions.ordered import exact_rank, running_totals
from tallyforge.functions.timing import micros
from tallyforge.operators import nodes
from tallyforge.operators.telemetry import TERMINAL_STATES, latest_by
from tallyforge.session import scratch_path

DELAY = "10 minutes"


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files of a table as a stream; the schema is that of the files present."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, path: str | None = None, mode: str = "append", name: str = "stream") -> DataFrame:
    """Processes what is available, then returns the written table.

    Results go to files and progress to a checkpoint, both in the shared folder, so a
    restarted query continues where it stopped. Update mode has no file sink; its
    batches are appended with their number.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{path}-progress").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(path)
    else:
        # A batch that is retried after a failure replaces its own folder.
        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

        query = writer.outputMode(mode).foreachBatch(put).start()
    query.awaitTermination()
    schema = stream.schema
    return spark.read.schema(schema).parquet(path)


def event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermark on a column, which must be a zoned timestamp; plain ones are read in the session zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def latest_run_changes(updates: DataFrame) -> DataFrame:
    """Update mode: the last state of every run that changed in the batch.

    State holds one row per run; use the RocksDB store (`STATE_STORE`) when it outgrows memory.
    """
    return updates.groupBy("run_id").agg(F.max(F.struct("updated_at", "seq", "state")).alias("last")).select(
        "run_id", "last.state", "last.updated_at", "last.seq"
    )


def latest_run_expiring(updates: DataFrame, keep: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Update mode as `latest_run_changes`, with state that goes: a run that has ended is forgotten once the watermark has
    passed its end, any other once it has passed its last update by `keep`.

    What arrives behind the watermark is dropped by Spark, so an ended run can't come back to life; an update of a run that
    was forgotten for its silence starts it anew, and the batch view still takes the latest of both.
    """
    silence = updates.sparkSession.sql(f"SELECT CAST(INTERVAL {keep} AS INTERVAL DAY TO SECOND)").first()[0]

    def last(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.getOption
        for part in parts:
            for row in part[["updated_at", "seq", "state"]].itertuples(index=False):
                found = (row.updated_at.to_pydatetime(), int(row.seq), row.state)
                best = found if best is None or found[:2] > tuple(best)[:2] else best
        state.update(tuple(best))
        # A timer must lie ahead of the watermark.
        due = pd.Timestamp(best[0]) + (pd.Timedelta(0) if best[2] in TERMINAL_STATES else pd.Timedelta(silence))
        state.setTimeoutTimestamp(max(int(due.tz_localize("UTC").timestamp() * 1000) if due.tzinfo is None else int(due.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run_id": [key[0]], "state": [best[2]], "updated_at": [best[0]], "seq": [best[1]]})

    timed = event_time(updates.select("run_id", "updated_at", F.col("seq").cast("long").alias("seq"), "state"), "updated_at", delay)
    kind = timed.schema["run_id"].dataType.simpleString()
    return timed.groupBy("run_id").applyInPandasWithState(
        last, f"run_id {kind}, state string, updated_at timestamp, seq long", "updated_at timestamp, seq long, state string", "update", GroupStateTimeout.EventTimeTimeout)


def latest_run_table(changes: DataFrame) -> DataFrame:
    """Batch view over written changes: one row per run."""
    return latest_by(changes, "run_id", ["updated_at", "seq"], ["state", "updated_at"])


def submission_window_counts(runs: DataFrame, every: str, delay: str = DELAY) -> DataFrame:
    """Submissions per tumbling window; empty windows do not appear."""
    counted = event_time(runs, "submitted_at", delay).groupBy(F.window("submitted_at", every).alias("w")).agg(
        F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def number_windows(windows: DataFrame) -> DataFrame:
    """Batch view over closed windows: their number in time order."""
    timed = windows.withColumn("_us", micros(F.col("window_start")))
    return exact_rank(timed, [], ["_us"], "time_window").drop("_us")


def free_memory(metrics: DataFrame, delay: str = DELAY) -> DataFrame:
    return nodes.free_memory_avg(event_time(metrics, "ts", delay))


def namespace_memory(metrics: DataFrame, delay: str = DELAY) -> DataFrame:
    """Two chained aggregations: sum per instant, then mean per sliding span.

    Only readings of the own namespace move the watermark; Spark filters before it anyway.
    """
    return nodes.namespace_memory_avg(event_time(nodes.own_containers(metrics), "ts", delay))


def assignment_outcomes(assignments: DataFrame, completions: DataFrame, horizon: str, delay: str = DELAY) -> DataFrame:
    """Assignments (pipeline_id, component, node_id, assigned_at) with done_at of the success reported within `horizon`.

    An assignment leaves with its completion, or without one when both watermarks have passed the horizon; state holds what
    lies between. Completions (pipeline_id, component, done_at) that come before their assignment wait for it as long.
    """
    left = event_time(assignments.select("pipeline_id", "component", "node_id", "assigned_at"), "assigned_at", delay)
    right = event_time(completions.select(F.col("pipeline_id").alias("_pipeline"), F.col("component").alias("_component"), "done_at"), "done_at", delay)
    met = (F.col("pipeline_id") == F.col("_pipeline")) & (F.col("component") == F.col("_component")) & (
        F.col("done_at") >= F.col("assigned_at")) & (F.col("done_at") <= F.col("assigned_at") + F.expr(f"INTERVAL {horizon}"))
    return left.join(right, met, "left_outer").drop("_pipeline", "_component")


def overdue_assignments(outcomes: DataFrame) -> DataFrame:
    """Batch view over written outcomes: what was never reported done."""
    return outcomes.filter("done_at IS NULL").select("pipeline_id", "component", "node_id")


def release_times(outcomes: DataFrame) -> DataFrame:
    """Batch view over written outcomes: when a pipeline freed a node, once all it had there is done."""
    per_node = outcomes.groupBy("pipeline_id", "node_id").agg(F.max("done_at").alias("released_at"), F.bool_and(F.col("done_at").isNotNull()).alias("_all"))
    return per_node.filter("_all").drop("_all")


def state_deltas(changes: DataFrame, every: str = "1 minute", delay: str = DELAY) -> DataFrame:
    """Changes (ts, running, waiting) summed per window; running totals follow in batch."""
    summed = event_time(changes, "ts", delay).groupBy(F.window("ts", every).alias("w")).agg(
        F.sum("running").alias("d_running"), F.sum("waiting").alias("d_waiting"))
    return summed.select(F.col("w.end").alias("ts"), "d_running", "d_waiting")


def totals_from_deltas(deltas: DataFrame) -> DataFrame:
    """Batch view over written deltas: running and waiting runs at the end of each window."""
    timed = deltas.withColumn("_us", micros(F.col("ts")))
    return running_totals(timed, "_us", {"d_running": "running", "d_waiting": "waiting"}).select("ts", "running", "waiting")
