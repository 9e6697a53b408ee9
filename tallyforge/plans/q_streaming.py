"""Streaming queries, run over everything available and checked against batch SQL.

Append mode emits a window once the watermark (latest event minus ten minutes) has
passed its end, so the SQL keeps just those windows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators.telemetry import terminal_runs
from tallyforge.plans.q_runlog import COUNTER_LOG_SQL
from tallyforge.functions.timing import micros
from tallyforge.plans.q_sources import local_times
from tallyforge.plans.q_telemetry import FREE_SQL, OWN_SQL, STATE_SQL, state_updates
from tallyforge.plans.registry import query
from tallyforge.session import scratch_path
from tallyforge.sources.files import read_counter_log
from tallyforge.streaming import jobs

WATERMARK_SQL = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def events(spark, folder):
    return jobs.table_stream(spark, folder, "events")


def gauges(spark, folder):
    namespace = F.when(F.col("event_type").isin("click", "view"), "kubeflow").otherwise("other")
    return events(spark, folder).select(
        "ts", (F.col("user_id") % 10).alias("node_id"), F.col("event_type").alias("container"), namespace.alias("namespace"),
        (F.col("value") * 1e6).alias("value"))


@query("latest_run_by_id_stream", """SELECT user_id AS run_id, event_type AS state, ts AS updated_at FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_run_by_id_stream(spark, folder):
    changes = jobs.latest_run_changes(state_updates(events(spark, folder)))
    return jobs.latest_run_table(jobs.run_available(changes, mode="update", name="latest-run"))


@query("latest_run_expiring_stream", """SELECT user_id AS run_id, event_type AS state, ts AS updated_at FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_run_expiring_stream(spark, folder):
    """The same table by a stream that forgets ended and silent runs."""
    changes = jobs.latest_run_expiring(state_updates(events(spark, folder)))
    return local_times(jobs.latest_run_table(jobs.run_available(changes, mode="update", name="latest-expiring")), "updated_at")


# The horizon ends at noon, dates at midnight, so no row lies on the border of the watermark.
OUTCOMES_SQL = """(WITH a AS (SELECT o_orderkey AS pipeline_id, 1 AS component, o_custkey % 10 AS node_id, CAST(o_orderdate AS TIMESTAMP) AS assigned_at FROM orders),
    c AS (SELECT l_orderkey AS pipeline_id, l_linenumber AS component, CAST(l_shipdate AS TIMESTAMP) AS done_at FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'R'),
    mark AS (SELECT least((SELECT max(assigned_at) FROM a), (SELECT max(done_at) FROM c)) - INTERVAL 1 DAY AS upto)
    SELECT a.*, done_at FROM a LEFT JOIN c ON a.pipeline_id = c.pipeline_id AND a.component = c.component AND done_at >= assigned_at
        AND done_at <= assigned_at + INTERVAL 60 DAY + INTERVAL 12 HOUR, mark WHERE done_at IS NOT NULL OR assigned_at + INTERVAL 60 DAY + INTERVAL 12 HOUR < upto)"""


def _outcomes(spark, folder):
    """Orders are assignments, their first lines that didn't come back the completions; sixty days and a half are the horizon."""
    assigned = jobs.table_stream(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pipeline_id"), F.lit(1).cast("bigint").alias("component"), (F.col("o_custkey") % 10).alias("node_id"), F.col("o_orderdate").alias("assigned_at"))
    done = jobs.table_stream(spark, folder, "lineitem").filter("l_linenumber = 1 AND l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("pipeline_id"), F.col("l_linenumber").cast("bigint").alias("component"), F.col("l_shipdate").alias("done_at"))
    return jobs.run_available(jobs.assignment_outcomes(assigned, done, "'60 12' DAY TO HOUR", "1 day"), name="outcomes")


@query("active_assignments_stream", f"SELECT pipeline_id, CAST(component AS BIGINT) AS component, node_id FROM {OUTCOMES_SQL} AS o WHERE done_at IS NULL")
def active_assignments_stream(spark, folder):
    return jobs.overdue_assignments(_outcomes(spark, folder))


@query("node_release_times_stream", f"""SELECT pipeline_id, node_id, max(done_at) AS released_at FROM {OUTCOMES_SQL} AS o GROUP BY pipeline_id, node_id
    HAVING bool_and(done_at IS NOT NULL)""")
def node_release_times_stream(spark, folder):
    return local_times(jobs.release_times(_outcomes(spark, folder)), "released_at")


@query("submission_windows_stream", f"""WITH w AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1)
    SELECT window_start, n, row_number() OVER (ORDER BY window_start) AS time_window FROM w
    WHERE window_start + INTERVAL 1 HOUR <= {WATERMARK_SQL}""")
def submission_windows_stream(spark, folder):
    submitted = events(spark, folder).select(F.col("ts").alias("submitted_at"))
    closed = jobs.run_available(jobs.submission_window_counts(submitted, "1 hour"), name="submissions")
    return local_times(jobs.number_windows(closed).select("window_start", "n", "time_window"), "window_start")


@query("free_memory_avg_stream", f"SELECT * FROM ({FREE_SQL}) AS f WHERE window_end <= {WATERMARK_SQL}")
def free_memory_avg_stream(spark, folder):
    closed = jobs.run_available(jobs.free_memory(gauges(spark, folder)), name="free-memory")
    return local_times(closed, "window_start", "window_end")


@query("namespace_memory_avg_stream", f"""SELECT * FROM ({OWN_SQL}) AS f WHERE window_end <=
    (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE event_type IN ('click', 'view'))""")
def namespace_memory_avg_stream(spark, folder):
    closed = jobs.run_available(jobs.namespace_memory(gauges(spark, folder)), name="own-memory")
    return local_times(closed, "window_start", "window_end")


@query("running_waiting_stream", f"""WITH c AS (SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE AS ts,
        sum(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) AS r,
        sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) AS w FROM events GROUP BY 1)
    SELECT ts, CAST(sum(r) OVER (ORDER BY ts) AS BIGINT) AS running, CAST(sum(w) OVER (ORDER BY ts) AS BIGINT) AS waiting
    FROM c WHERE ts <= {WATERMARK_SQL}""")
def running_waiting_stream(spark, folder):
    """A click submits a run, a view starts it, a purchase ends it."""
    kind = F.col("event_type")
    changes = events(spark, folder).select(
        "ts", F.when(kind == "view", 1).when(kind == "purchase", -1).otherwise(0).alias("running"),
        F.when(kind == "click", 1).when(kind == "view", -1).otherwise(0).alias("waiting"))
    return local_times(jobs.totals_from_deltas(jobs.run_available(jobs.state_deltas(changes), name="deltas")), "ts")


@query("terminal_runs_stream", f"""SELECT event_id AS run_id, {STATE_SQL} AS state FROM events
    WHERE {STATE_SQL} IN ('SUCCEEDED', 'FAILED')""")
def terminal_runs_stream(spark, folder):
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "SUCCEEDED").when(kind == "error", "FAILED").otherwise("RUNNING")
    rows = events(spark, folder).select(F.col("event_id").alias("run_id"), state.alias("state"))
    return jobs.run_available(terminal_runs(rows), name="terminal")


@query("counter_log_stream", COUNTER_LOG_SQL)
def counter_log_stream(spark, folder):
    """Counter rows appended to a CSV log by a streaming sink."""
    rows = events(spark, folder).select(
        (micros(F.col("ts")) / F.lit(1e6)).alias("timestamp"),
        F.when(F.col("event_type") == "error", "new_window").otherwise("update").alias("type"),
        (F.col("user_id") % 7).cast("int").alias("running_pipelines"), (F.col("event_id") % 5).cast("int").alias("waiting_pipelines"))
    path = scratch_path(spark, "counter-stream")
    sink = rows.writeStream.format("csv").option("header", True).option("checkpointLocation", f"{path}-progress")
    sink.outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return read_counter_log(spark, path)
