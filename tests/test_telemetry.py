from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyforge.operators import datasets, nodes
from tallyforge.operators import telemetry as ops

T0 = datetime(2025, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def test_times_are_normalised(spark):
    epoch = datetime(1970, 1, 1)
    df = spark.createDataFrame([(1, at(0), at(2.675)), (2, at(0), epoch), (3, at(5), at(3)), (4, at(0), None)],
                               "run_id int, scheduled_at timestamp, finished_at timestamp")
    got = {r["run_id"]: (r["duration"], r["finished_at"]) for r in ops.normalize_run(df).collect()}
    assert got == {1: (round(2.675, 2), at(2.675)), 2: (None, None), 3: (None, at(3)), 4: (None, None)}


def test_reports_of_unknown_components_are_dropped(spark):
    details = spark.createDataFrame([("p", "a", at(0), at(1)), ("p", "driver", at(0), at(1))],
                                    "pipeline_id string, component string, start_time timestamp, end_time timestamp")
    known = spark.createDataFrame([("p", "a"), ("p", "a")], "pipeline_id string, component string")
    assert [r["component"] for r in ops.normalize_task(details, known).collect()] == ["a"]


def test_prefix_matches_whole_names_and_longer_ones(spark):
    pipelines = spark.createDataFrame([(1, "Mnist_CNN"), (2, "mnist_cnn2"), (3, "none"), (4, "Mnist_CNN")], "pipeline_id int, name string")
    runs = spark.createDataFrame([(10, "mnist-cnn 2025-01-01", 1), (11, "mnist-cnn2 2025-01-01", 2), (12, "x mnist-cnn", 3)],
                                 "run_id int, display_name string, seq int")
    got = {r["pipeline_id"]: r["run_id"] for r in ops.prefix_match_run(pipelines, runs).collect()}
    assert got == {1: 11, 2: 11, 3: None, 4: 11}


def test_windows_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([(1, at(3)), (2, at(9)), (3, at(61)), (4, at(62))], "run_id int, submitted_at timestamp")
    got = {r["run_id"]: r["time_window"] for r in ops.submission_windows(df, "10 seconds").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2}


def test_counts_over_time(spark):
    df = spark.createDataFrame([(at(0), at(5), at(9)), (at(0), at(5), None), (at(9), None, None)],
                               "submitted_at timestamp, scheduled_at timestamp, finished_at timestamp")
    got = [(r["running"], r["waiting"]) for r in ops.running_waiting_counts(df).orderBy("ts").collect()]
    assert got == [(0, 2), (2, 0), (1, 1)]


def test_nodes_are_freed_and_needed(spark):
    tasks = spark.createDataFrame([("p", "a", 1, "SUCCEEDED", at(1)), ("p", "b", 1, "SUCCEEDED", at(4)), ("p", "c", 2, None, None),
                                   ("p", "d", 2, "SUCCEEDED", at(2))], "pipeline_id string, component string, node_id int, state string, end_time timestamp")
    assert [(r["node_id"], r["released_at"]) for r in ops.node_release_times(tasks).collect()] == [(1, at(4))]
    active = ops.active_assignments(tasks.select("pipeline_id", "component", "node_id"), tasks)
    assert [r["component"] for r in active.collect()] == ["c"]
    pairs = tasks.select("pipeline_id", "node_id").distinct()
    assert [r["node_id"] for r in ops.still_needed_nodes(pairs, active).collect()] == [2]


def test_ready_and_lookup(spark):
    need = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "pipeline_id string, node_id int")
    busy = spark.createDataFrame([(1, None), (2, "x")], "node_id int, occupant string")
    assert [r[0] for r in ops.ready_pipelines(need, busy).collect()] == ["q"]
    assert ops.run_lookup(need, "pipeline_id", "zzz").count() == 0


def test_node_inventory(spark):
    rows = [("a", "agent --x", [("Ready", "True")]), ("b", "agent", [("Ready", "False")]), ("c", "server", [("Ready", "True")]), ("d", None, []),
            ("e", "agent", None)]
    df = spark.createDataFrame(rows, "node string, node_args string, conditions array<struct<type: string, status: string>>")
    assert [r["node"] for r in nodes.ready_workers(df).collect()] == ["a"]
    q = spark.createDataFrame([("16384Ki",), ("bad",)], "q string").select(nodes.parse_quantity(F.col("q")))
    assert [r[0] for r in q.collect()] == [16384, None]
    kept = nodes.node_filter_sort(df, {"node": ["a", "b", "c"]}, ["node"], descending=True)
    assert [r["node"] for r in kept.collect()] == ["c", "b", "a"]
    total = spark.createDataFrame([(1, 1000), (2, 0)], "node_id int, memory_kb bigint")
    free = spark.createDataFrame([(1, 250)], "node_id int, free_kb bigint")
    own = spark.createDataFrame([], "node_id int, used_kb bigint")
    got = {r["node_id"]: r["memory_usage_2dp"] for r in nodes.memory_usage_ratio(total, free, own).collect()}
    assert got == {1: 0.75, 2: None}


def test_memory_averages_are_those_of_any_row_order(spark):
    """Five readings whose exact mean is half a KiB: summed as doubles, the largest first, the ones are lost."""
    total = 5 * 512 * (2 * 2 ** 41 + 1)
    readings = [float(total - 4), 1.0, 1.0, 1.0, 1.0]
    schema = "node_id int, ts timestamp, container string, namespace string, value double"
    for order in (readings, readings[::-1]):
        apart = spark.createDataFrame([(1, at(k), "c", "kubeflow", v) for k, v in enumerate(order)], schema).coalesce(1)
        together = spark.createDataFrame([(1, at(9), str(k), "kubeflow", v) for k, v in enumerate(order)], schema).coalesce(1)
        assert {r["used_kb"] for r in nodes.namespace_memory_avg(apart).collect()} == {2 ** 41 + 1}
        assert {r["used_kb"] for r in nodes.namespace_memory_avg(together).collect()} == {total // 1024 + 1}
    half = spark.createDataFrame([(1, at(0), "c", "kubeflow", 1535.75), (1, at(1), "c", "kubeflow", 1536.25), (1, at(2), "c", "kubeflow", None)], schema)
    assert {r["used_kb"] for r in nodes.namespace_memory_avg(half).collect()} == {2}


def test_registry(spark, tmp_path):
    for name, size in (("wine", 3000), ("adult", 10), (".hidden", 10)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "data.csv").write_bytes(b"x" * size)
    (tmp_path / "wine" / "more.csv").write_bytes(b"x" * 2000)
    got = {r["name"]: r["size_kb"] for r in datasets.dataset_registry(spark, str(tmp_path)).collect()}
    assert got == {"wine": 5, "adult": 1}
    old = spark.createDataFrame([("a", "p", 1, at(5)), ("b", "p", 1, at(5))], "name string, path string, size_kb bigint, modified_at timestamp")
    new = spark.createDataFrame([("a", "p", 2, at(5)), ("b", "p", 2, at(6)), ("c", "p", 2, at(0))], old.schema)
    got = {r["name"]: r["size_kb"] for r in datasets.registry_refresh(old, new).collect()}
    assert got == {"a": 1, "b": 2, "c": 2}
