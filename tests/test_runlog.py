from datetime import datetime, timedelta
from statistics import pstdev

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyforge.functions.numbers import round_2dp
from tallyforge.operators import runlog as ops

T0 = datetime(2025, 1, 1)
SCHEMA = "strategy string, experiment bigint, run_id bigint, name string, submitted_at timestamp, scheduled_at timestamp, finished_at timestamp"


def run(strategy, experiment, run_id, name, sub, start, end):
    at = [None if s is None else T0 + timedelta(seconds=s) for s in (sub, start, end)]
    return (strategy, experiment, run_id, name, *at)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_round_2dp_equals_python(spark):
    values = [2.675, 0.125, 0.615, 1.005, -2.675, -0.125, 0.0, 1e12 + 0.125, 123456.785, 99.995]

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=200))
    def check(more):
        data = values + more + [round(v, 3) for v in more]
        rows = spark.createDataFrame([(v,) for v in data], "v double").select("v", round_2dp(F.col("v")).alias("r")).collect()
        assert all(r["r"] == round(r["v"], 2) for r in rows)

    check()


def test_seconds_are_cut_before_they_are_averaged(spark):
    runs = frame(spark, run("s", 0, 1, "a", 0, 1.9, 3.8), run("s", 1, 2, "a", 0, 0.9, 2.85))
    row = ops.run_exec_avg_std(runs).first()
    assert (row["exec_avg"], row["exec_std"]) == (1.0, 0.0)
    # The mean is taken over whole microseconds: 1.925, where summing the doubles 1.9 and 1.95 gives 1.9249999999999998.
    outside = ops.external_exec_avg_std(runs).first()
    assert (outside["exec_avg"], outside["exec_avg_2dp"]) == (3_850_000 / 2 / 1e6, round(1.925, 2))


def test_last_run_of_a_name_wins_but_totals_keep_all(spark):
    runs = frame(spark, run("s", 0, 2, "a", 5, 9, 20), run("s", 0, 1, "a", 5, 6, 7), run("s", 0, 0, "a", 1, 4, 5))
    assert ops.run_exec_times(runs).first()["exec_s"] == 11
    assert ops.run_wait_times(runs).first()["wait_s"] == 4
    assert ops.total_wait(runs).first()["total_wait_s"] == 4 + 1 + 3


def test_unfinished_runs_are_left_out_and_negative_times_cut_toward_zero(spark):
    runs = frame(spark, run("s", 0, 1, "a", 0, 1, 3), run("s", 0, 2, "b", 0, 2, None), run("s", 0, 3, "c", 0, 5.5, 3.8))
    assert ops.makespan(runs).first()["makespan_s"] == 2
    assert {r["name"]: r["exec_s"] for r in ops.run_exec_times(runs).collect()} == {"a": 2, "c": -1}


def test_spread_is_population_and_zero_for_one(spark):
    runs = frame(spark, *[run("s", e, e, "a", 0, 0, 10 * (e + 1)) for e in range(3)], run("one", 0, 9, "a", 0, 0, 4))
    got = {r["strategy"]: r for r in ops.makespan_avg_std(runs).collect()}
    assert got["s"]["makespan_std_2dp"] == round(pstdev([10, 20, 30]), 2)
    assert got["one"]["makespan_std"] == 0.0


def test_comparison_with_missing_main_and_zero_time(spark):
    times = spark.createDataFrame([("m", 10.0), ("x", 40.0), ("z", 0.0)], "strategy string, t double")
    got = {r["strategy"]: (r["reduction_2dp"]) for r in ops.reduction_pct(times, "m", "t").collect()}
    assert got == {"x": -75.0, "z": None}
    assert {r["strategy"]: r["speedup"] for r in ops.speedup_ratio(times, "m", "t").collect()} == {"x": 4.0, "z": 0.0}
    assert all(r["reduction"] is None for r in ops.reduction_pct(times, "none", "t").collect())


def test_empty_log(spark):
    runs = frame(spark)
    assert ops.strategy_summary(runs, "m").count() == 0
    assert ops.population_std(runs.select("strategy", F.lit(1.0).alias("v")), [], "v").first()["std"] == 0.0


def test_counter_log_series(spark):
    log = spark.createDataFrame([(100.9, "update", 0, 1), (103.2, "new_window", 0, 1), (103.2, "update", 1, 0)],
                                "timestamp double, type string, running_pipelines int, waiting_pipelines int")
    assert [r["elapsed_time"] for r in ops.window_marks(log).collect()] == [2]
    got = sorted((r["elapsed_time"], r["series"], r["value"]) for r in ops.plot_series(log).filter("value IS NOT NULL").collect())
    assert got == [(0, "running", 0), (0, "waiting", 1), (2, "running", 1), (2, "waiting", 0)]
