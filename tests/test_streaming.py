"""Streams over several files: late rows, restarts, and equality with the batch form."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import nodes
from tallyforge.streaming import jobs

T0 = datetime(2025, 1, 1)
GAUGE = "ts timestamp, node_id int, namespace string, container string, value double"


def write(spark, root, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/part={number}")


def stream(spark, root, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(root)


def gauge(minute, value, container="c", node=1):
    return (T0 + timedelta(minutes=minute), node, "kubeflow", container, float(value))


@pytest.mark.parametrize("form", ["free", "own"])
def test_sliding_average_equals_batch_without_the_late_row(spark, tmp_path, form):
    root, out = f"{tmp_path}/in", f"{tmp_path}/out"
    on_time = [[gauge(m, 1024 * m) for m in range(0, 20)] + [gauge(m, 2048, "d") for m in range(0, 20, 3)],
               [gauge(m, 1024 * m) for m in range(20, 60)]]
    for i, rows in enumerate(on_time):
        write(spark, root, i, rows, GAUGE)
    make = jobs.free_memory if form == "free" else jobs.namespace_memory
    batch = nodes.free_memory_avg if form == "free" else nodes.namespace_memory_avg
    jobs.run_available(make(stream(spark, root, GAUGE)), out)
    # A row 40 minutes behind is late; a later row closes more windows. The query resumes from its checkpoint.
    write(spark, root, 2, [gauge(5, 10**9), gauge(90, 1024)], GAUGE)
    got = jobs.run_available(make(stream(spark, root, GAUGE)), out)
    rows = [r for part in on_time for r in part] + [gauge(90, 1024)]
    closed = T0 + timedelta(minutes=90 - 10)
    want = batch(spark.createDataFrame(rows, GAUGE)).filter(F.col("window_end") <= F.lit(closed))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 50


def test_latest_state_over_batches(spark, tmp_path):
    schema = "run_id int, state string, updated_at timestamp, seq int"
    root, out = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, root, 0, [(1, "RUNNING", T0, 1), (2, "RUNNING", T0, 1)], schema)
    write(spark, root, 1, [(1, "SUCCEEDED", T0 + timedelta(seconds=9), 2), (2, "PENDING", T0 - timedelta(seconds=9), 3)], schema)
    changes = jobs.run_available(jobs.latest_run_changes(stream(spark, root, schema)), out, mode="update")
    got = {r["run_id"]: r["state"] for r in jobs.latest_run_table(changes).collect()}
    assert got == {1: "SUCCEEDED", 2: "RUNNING"}


def test_window_counts_and_totals(spark, tmp_path):
    root, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "ts timestamp, running int, waiting int"
    write(spark, root, 0, [(T0 + timedelta(seconds=s), r, w) for s, r, w in ((1, 0, 1), (2, 1, -1), (130, 0, 1))], schema)
    write(spark, root, 1, [(T0 + timedelta(seconds=s), r, w) for s, r, w in ((140, -1, 0), (4000, 0, 0))], schema)
    deltas = jobs.run_available(jobs.state_deltas(stream(spark, root, schema)), out)
    got = [(r["running"], r["waiting"]) for r in jobs.totals_from_deltas(deltas).orderBy("ts").collect()]
    assert got == [(1, 0), (0, 1)]
    submitted = stream(spark, root, schema).select(F.col("ts").alias("submitted_at"))
    closed = jobs.run_available(jobs.submission_window_counts(submitted, "1 minute"), f"{tmp_path}/windows")
    got = [(r["time_window"], r["n"]) for r in jobs.number_windows(closed).orderBy("time_window").collect()]
    assert got == [(1, 2), (2, 2)]


def progress_of(frame, out, mode):
    """Runs a stream to its end; its table, and the rows of state after every batch."""
    spark, held = frame.sparkSession, []
    query = (frame.writeStream.option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).outputMode(mode)
             .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")).start())
    query.awaitTermination()
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    return spark.read.schema(frame.schema).option("recursiveFileLookup", True).parquet(out), held


def test_expiring_state_stays_bounded(spark, tmp_path):
    schema = "run_id long, state string, updated_at timestamp, seq int"
    root, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = []

    def put(number, part):
        rows.extend(part)
        write(spark, root, number, part, schema)

    # Runs of an hour each, a hundred at a time; one is silent, one starts again after it was forgotten.
    for hour in range(6):
        at = T0 + timedelta(hours=hour)
        part = [(100 * hour + k, "RUNNING", at, 1) for k in range(100)] + [(100 * hour + k, "SUCCEEDED", at + timedelta(minutes=50), 2) for k in range(100)]
        put(hour, part + ([(7000, "RUNNING", at, 1)] if hour == 0 else []))
    make = lambda: jobs.latest_run_expiring(stream(spark, root, schema), keep="2 hours")
    _, held = progress_of(make(), out, "update")
    assert max(held) <= 202 and held[-1] <= 101
    # After a restart: a late row of an ended run is dropped, the silent run begins anew.
    put(6, [(7000, "RUNNING", T0 + timedelta(hours=7), 5), (9, "SUCCEEDED", T0 + timedelta(hours=7), 3)])
    write(spark, root, 7, [(510, "FAILED", T0 + timedelta(minutes=1), 99)], schema)
    changes, held = progress_of(make(), out, "update")
    got = {r["run_id"]: (r["state"], r["updated_at"]) for r in jobs.latest_run_table(changes).collect()}
    want = {}
    for run, state, at, seq in rows:
        want[run] = max(want.get(run, (T0, -1, "")), (at, seq, state))
    assert got == {run: (state, at) for run, (at, seq, state) in want.items()}
    assert held[-1] <= 102


def test_assignments_meet_completions(spark, tmp_path):
    a_schema, c_schema = "pipeline_id long, component long, node_id long, assigned_at timestamp", "pipeline_id long, component long, done_at timestamp"
    at = lambda m: T0 + timedelta(minutes=m)
    left, right, out = f"{tmp_path}/a", f"{tmp_path}/c", f"{tmp_path}/out"
    write(spark, left, 0, [(1, 1, 5, at(0)), (1, 2, 5, at(0)), (2, 1, 6, at(1)), (3, 1, 7, at(2))], a_schema)
    write(spark, right, 0, [(1, 1, at(9)), (2, 1, at(300))], c_schema)
    make = lambda: jobs.assignment_outcomes(stream(spark, left, a_schema), stream(spark, right, c_schema), "1 hour")
    first = jobs.run_available(make(), out)
    assert {(r.pipeline_id, r.component) for r in first.collect()} == {(1, 1)}
    # A restart: a completion meets an assignment of the first run, later ones move both watermarks past the horizon.
    write(spark, left, 1, [(9, 1, 1, at(500))], a_schema)
    write(spark, right, 1, [(1, 2, at(31)), (9, 9, at(500))], c_schema)
    jobs.run_available(make(), out)
    write(spark, left, 2, [(10, 1, 1, at(600))], a_schema)
    write(spark, right, 2, [(3, 1, at(20)), (9, 9, at(600))], c_schema)  # late: dropped
    done = jobs.run_available(make(), out)
    got = {(r.pipeline_id, r.component): r.done_at for r in done.collect()}
    assert got == {(1, 1): at(9), (1, 2): at(31), (2, 1): None, (3, 1): None, (9, 1): None}
    assert {r.pipeline_id for r in jobs.overdue_assignments(done).collect()} == {2, 3, 9}
    assert [tuple(r) for r in jobs.release_times(done).collect()] == [(1, 5, at(31))]


def test_own_memory_of_a_stream_is_that_of_any_row_order(spark, tmp_path):
    """Five readings whose exact mean is half a KiB, the largest first; a later row closes their window."""
    total = 5 * 512 * (2 * 2 ** 41 + 1)
    readings = [gauge(k / 60, v) for k, v in enumerate([total - 4, 1, 1, 1, 1])] + [gauge(90, 1)]
    write(spark, f"{tmp_path}/in", 0, readings, GAUGE)
    got = jobs.run_available(jobs.namespace_memory(stream(spark, f"{tmp_path}/in", GAUGE)), f"{tmp_path}/out")
    assert {r["used_kb"] for r in got.where(F.col("window_end") < F.lit(T0 + timedelta(hours=1))).collect()} == {2 ** 41 + 1}
