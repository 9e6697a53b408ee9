"""Run-log analytics: makespan, execution and waiting times, speed-up between strategies.

Input rows are runs: strategy, experiment, run_id, name, submitted_at, scheduled_at,
finished_at. Seconds are truncated per run before averaging. Per-name results keep the
last run of a repeated name, by (submitted_at, run_id); totals keep every run. Spreads
are population standard deviations. Unfinished runs take no part in finish-based times.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.functions.numbers import round_2dp, std_or_zero, truncate
from tallyforge.functions.timing import micros_between, whole_seconds_between

EXPERIMENT = ("strategy", "experiment")


def _exec_seconds() -> Column:
    return whole_seconds_between(F.col("scheduled_at"), F.col("finished_at"))


def _wait_seconds() -> Column:
    return whole_seconds_between(F.col("submitted_at"), F.col("scheduled_at"))


def mean_and_spread(df: DataFrame, keys: Sequence[str], value: str, name: str, per: float = 1.0) -> DataFrame:
    """Mean and population spread of `value` per `keys`, exact and with two decimals.

    `per` converts the unit after averaging: sums of whole microseconds are exact in any
    order, sums of fractions of a second are not.
    """
    mean, spread = F.avg(value) / F.lit(per), std_or_zero(F.col(value)) / F.lit(per)
    stats = df.groupBy(*keys).agg(mean.alias(f"{name}_avg"), spread.alias(f"{name}_std"))
    return stats.select(
        *keys,
        f"{name}_avg",
        f"{name}_std",
        round_2dp(F.col(f"{name}_avg")).alias(f"{name}_avg_2dp"),
        round_2dp(F.col(f"{name}_std")).alias(f"{name}_std_2dp"),
    )


def _last_per_name(runs: DataFrame, value: Column, out: str) -> DataFrame:
    """Value of the last run of each name in an experiment; combines map-side, so hot names are safe."""
    order = F.struct("submitted_at", "run_id")
    return (
        runs.select(*EXPERIMENT, "name", order.alias("_order"), value.alias("_value"))
        .filter(F.col("_value").isNotNull())
        .groupBy(*EXPERIMENT, "name")
        .agg(F.max(F.struct("_order", "_value")).alias("_last"))
        .select(*EXPERIMENT, "name", F.col("_last._value").alias(out))
    )


def makespan(runs: DataFrame) -> DataFrame:
    """Whole seconds from the first schedule to the last finish of each experiment."""
    done = runs.filter(F.col("finished_at").isNotNull() & F.col("scheduled_at").isNotNull())
    span = done.groupBy(*EXPERIMENT).agg(F.min("scheduled_at").alias("_first"), F.max("finished_at").alias("_last"))
    return span.select(*EXPERIMENT, whole_seconds_between(F.col("_first"), F.col("_last")).alias("makespan_s"))


def makespan_avg_std(runs: DataFrame) -> DataFrame:
    return mean_and_spread(makespan(runs), ["strategy"], "makespan_s", "makespan")


def run_exec_times(runs: DataFrame) -> DataFrame:
    return _last_per_name(runs, _exec_seconds(), "exec_s")


def run_exec_avg_std(runs: DataFrame) -> DataFrame:
    return mean_and_spread(run_exec_times(runs), ["strategy", "name"], "exec_s", "exec")


def total_wait(runs: DataFrame) -> DataFrame:
    """Sum of whole waiting seconds of every run, repeated names included."""
    return runs.groupBy(*EXPERIMENT).agg(F.coalesce(F.sum(_wait_seconds()), F.lit(0)).alias("total_wait_s"))


def total_wait_avg_std(runs: DataFrame) -> DataFrame:
    return mean_and_spread(total_wait(runs), ["strategy"], "total_wait_s", "total_wait")


def run_wait_times(runs: DataFrame) -> DataFrame:
    return _last_per_name(runs, _wait_seconds(), "wait_s")


def run_wait_avg_std(runs: DataFrame) -> DataFrame:
    return mean_and_spread(run_wait_times(runs), ["strategy", "name"], "wait_s", "wait")


def wait_avg(runs: DataFrame) -> DataFrame:
    """Mean wait over the distinct names of each experiment."""
    mean = run_wait_times(runs).groupBy(*EXPERIMENT).agg(F.avg("wait_s").alias("wait_avg"))
    return mean.withColumn("wait_avg_2dp", round_2dp(F.col("wait_avg")))


def wait_avg_multi(runs: DataFrame) -> DataFrame:
    """Mean and spread over experiments of the unrounded `wait_avg`."""
    return mean_and_spread(wait_avg(runs), ["strategy"], "wait_avg", "wait")


def against_main(times: DataFrame, main: str, value: str) -> DataFrame:
    """Every other strategy's time next to the main strategy's.

    `times` has one row per strategy, so the main time is found by a window over those
    few rows and the runs behind them are read once. Without a main row every
    comparison is null.
    """
    everything = Window.partitionBy(F.lit(0))
    main_time = F.max(F.when(F.col("strategy") == main, F.col(value))).over(everything)
    paired = times.select("strategy", F.col(value).cast("double").alias("time_s"), main_time.cast("double").alias("main_s"))
    return paired.filter(F.col("strategy") != main)


def _reduction() -> Column:
    return F.try_divide(F.col("main_s") - F.col("time_s"), F.col("time_s")) * 100


def _speedup() -> Column:
    return F.try_divide(F.col("time_s"), F.col("main_s"))


def reduction_pct(times: DataFrame, main: str, value: str) -> DataFrame:
    """(main - t) / t * 100 for each baseline; negative when the main strategy is faster."""
    return against_main(times, main, value).select(
        "strategy", _reduction().alias("reduction"), round_2dp(_reduction()).alias("reduction_2dp")
    )


def speedup_ratio(times: DataFrame, main: str, value: str) -> DataFrame:
    """t / main for each baseline: how many times faster the main strategy is."""
    return against_main(times, main, value).select(
        "strategy", _speedup().alias("speedup"), round_2dp(_speedup()).alias("speedup_2dp")
    )


def _external_span(runs: DataFrame) -> DataFrame:
    done = runs.filter(F.col("finished_at").isNotNull())
    span = done.groupBy(*EXPERIMENT).agg(F.min("submitted_at").alias("_first"), F.max("finished_at").alias("_last"))
    return span.select(*EXPERIMENT, micros_between(F.col("_first"), F.col("_last")).alias("_us"))


def external_makespan(runs: DataFrame) -> DataFrame:
    """External runner: first creation (submitted_at) to last finish, fraction kept."""
    return _external_span(runs).select(*EXPERIMENT, (F.col("_us") / F.lit(1e6)).alias("makespan_s"))


def external_makespan_avg_std(runs: DataFrame) -> DataFrame:
    return mean_and_spread(_external_span(runs), ["strategy"], "_us", "makespan", per=1e6)


def external_exec_avg_std(runs: DataFrame) -> DataFrame:
    """External runner: every run counts, with its fraction of a second."""
    timed = runs.select("strategy", "name", micros_between(F.col("scheduled_at"), F.col("finished_at")).alias("_us"))
    return mean_and_spread(timed.filter("_us IS NOT NULL"), ["strategy", "name"], "_us", "exec", per=1e6)


def population_std(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Population standard deviation, 0 when a group has no values."""
    spread = df.groupBy(*keys).agg(std_or_zero(F.col(value)).alias("std"))
    return spread.withColumn("std_2dp", round_2dp(F.col("std")))


def strategy_table(parts: Sequence[tuple[str | None, DataFrame]], value: str) -> DataFrame:
    """Long table (strategy, name, value) from (label, frame) pairs; without a label the frame has its own."""
    labelled = [df.select((F.col("strategy") if label is None else F.lit(label)).alias("strategy"), "name",
                          F.col(value).cast("double").alias(value)) for label, df in parts]
    return reduce(DataFrame.unionByName, labelled)


def elapsed_time(log: DataFrame) -> DataFrame:
    """Adds whole seconds since the earliest row of a counter log."""
    start = log.agg(F.min("timestamp").alias("s")).scalar()
    return log.withColumn("elapsed_time", truncate(F.col("timestamp") - start))


def window_marks(log: DataFrame) -> DataFrame:
    """Elapsed seconds at which a submission window opened."""
    return elapsed_time(log).filter(F.col("type") == "new_window").select("elapsed_time")


def plot_series(log: DataFrame) -> DataFrame:
    """Tidy series: running and waiting counts of `update` rows, and the window marks."""
    timed = elapsed_time(log)
    counts = timed.filter(F.col("type") == "update").select(
        "elapsed_time",
        F.explode(F.create_map(F.lit("running"), F.col("running_pipelines").cast("bigint"),
                               F.lit("waiting"), F.col("waiting_pipelines").cast("bigint"))).alias("series", "value"),
    )
    marks = timed.filter(F.col("type") == "new_window").select(
        "elapsed_time", F.lit("mark").alias("series"), F.lit(None).cast("bigint").alias("value")
    )
    return counts.unionByName(marks)


def strategy_summary(runs: DataFrame, main: str) -> DataFrame:
    """Makespan and mean waiting time per strategy with reduction and speed-up of `main`.

    One pass over the runs: name level, then experiment, then strategy, each a smaller
    shuffle than the one before.
    """
    done = F.col("finished_at").isNotNull() & F.col("scheduled_at").isNotNull()
    order = F.struct("submitted_at", "run_id")
    names = runs.groupBy(*EXPERIMENT, "name").agg(
        F.min(F.when(done, F.col("scheduled_at"))).alias("_first"),
        F.max(F.when(done, F.col("finished_at"))).alias("_last"),
        F.max(F.when(_wait_seconds().isNotNull(), F.struct(order.alias("o"), _wait_seconds().alias("wait_s")))).alias("_wait"),
    )
    experiments = names.groupBy(*EXPERIMENT).agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.avg("_wait.wait_s").alias("_wait"))
    spans = experiments.withColumn("_span", whole_seconds_between(F.col("_first"), F.col("_last")))
    both = spans.groupBy("strategy").agg(
        F.avg("_span").alias("makespan_avg"), std_or_zero(F.col("_span")).alias("makespan_std"),
        F.avg("_wait").alias("wait_avg"), std_or_zero(F.col("_wait")).alias("wait_std"),
    ).filter("makespan_avg IS NOT NULL")
    everything = Window.partitionBy(F.lit(0))

    def versus(value: str, out: str) -> list[Column]:
        """Comparison with the main row; one row per strategy meets in the window."""
        t, other = F.col(value), F.col("strategy") != main
        m = F.max(F.when(F.col("strategy") == main, t)).over(everything)
        return [F.when(other, F.try_divide(m - t, t) * 100).alias(f"{out}_reduction"),
                F.when(other, F.try_divide(t, m)).alias(f"{out}_speedup")]

    return both.select(
        "strategy", "makespan_avg", "makespan_std", *versus("makespan_avg", "makespan"),
        "wait_avg", "wait_std", *versus("wait_avg", "wait"),
    )
