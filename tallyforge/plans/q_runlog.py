"""Queries over run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.timing import micros
from tallyforge.operators import runlog as ops
from tallyforge.plans.registry import query
from tallyforge.plans.views import view
from tallyforge.sources.tables import table

MAIN = "purchase"

WHOLE_EXEC = "CAST(trunc((epoch_us(finished_at) - epoch_us(scheduled_at)) / 1e6) AS BIGINT)"
WHOLE_WAIT = "CAST(trunc((epoch_us(scheduled_at) - epoch_us(submitted_at)) / 1e6) AS BIGINT)"
MICROS_EXEC = "epoch_us(finished_at) - epoch_us(scheduled_at)"

MAKESPAN_SQL = """SELECT strategy, experiment,
    CAST(trunc((epoch_us(max(finished_at)) - epoch_us(min(scheduled_at))) / 1e6) AS BIGINT) AS makespan_s
    FROM v_runs WHERE finished_at IS NOT NULL GROUP BY strategy, experiment"""

KFP_SPAN_SQL = """SELECT strategy, experiment, epoch_us(max(finished_at)) - epoch_us(min(submitted_at)) AS us
    FROM v_runs GROUP BY strategy, experiment"""


def last_per_name(value: str, out: str) -> str:
    return f"""SELECT strategy, experiment, name, {value} AS {out}
    FROM v_runs WHERE {value} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY strategy, experiment, name
                                           ORDER BY submitted_at DESC, run_id DESC) = 1"""


TOTAL_WAIT_SQL = f"""SELECT strategy, experiment, CAST(coalesce(sum({WHOLE_WAIT}), 0) AS BIGINT) AS total_wait_s
    FROM v_runs GROUP BY strategy, experiment"""

WAIT_AVG_SQL = f"""SELECT strategy, experiment, avg(wait_s) AS wait_avg
    FROM ({last_per_name(WHOLE_WAIT, 'wait_s')}) AS w GROUP BY strategy, experiment"""


def stats_sql(inner: str, keys: str, value: str, name: str, digits: str = "", per: str = "1") -> str:
    """Means of whole numbers are exact in both engines; `digits` rounds means of fractions."""
    mean = f"avg({value}) / {per}"
    shown = f"round({mean}, {digits})" if digits else mean
    return f"""SELECT {keys}, {shown} AS {name}_avg, round(stddev_pop({value}) / {per}, 6) AS {name}_std,
    CAST(format('{{:.2f}}', {mean}) AS DOUBLE) AS {name}_avg_2dp,
    CAST(format('{{:.2f}}', stddev_pop({value}) / {per}) AS DOUBLE) AS {name}_std_2dp
    FROM ({inner}) AS per_group GROUP BY {keys}"""


def rounded(df, *names: str, digits: int = 6):
    """Fixes the last bits of floating sums, whose order differs between engines."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def _runs(spark, folder):
    return view(spark, folder, "v_runs")


@query("makespan", MAKESPAN_SQL)
def makespan(spark, folder):
    return ops.makespan(_runs(spark, folder))


@query("makespan_avg_std", stats_sql(MAKESPAN_SQL, "strategy", "makespan_s", "makespan"))
def makespan_avg_std(spark, folder):
    return rounded(ops.makespan_avg_std(_runs(spark, folder)), "makespan_std")


@query("run_exec_times", last_per_name(WHOLE_EXEC, "exec_s"))
def run_exec_times(spark, folder):
    return ops.run_exec_times(_runs(spark, folder))


@query("run_exec_avg_std", stats_sql(last_per_name(WHOLE_EXEC, "exec_s"), "strategy, name", "exec_s", "exec"))
def run_exec_avg_std(spark, folder):
    return rounded(ops.run_exec_avg_std(_runs(spark, folder)), "exec_std")


@query("total_wait", TOTAL_WAIT_SQL)
def total_wait(spark, folder):
    return ops.total_wait(_runs(spark, folder))


@query("total_wait_avg_std", stats_sql(TOTAL_WAIT_SQL, "strategy", "total_wait_s", "total_wait"))
def total_wait_avg_std(spark, folder):
    return rounded(ops.total_wait_avg_std(_runs(spark, folder)), "total_wait_std")


@query("run_wait_times", last_per_name(WHOLE_WAIT, "wait_s"))
def run_wait_times(spark, folder):
    return ops.run_wait_times(_runs(spark, folder))


@query("run_wait_avg_std", stats_sql(last_per_name(WHOLE_WAIT, "wait_s"), "strategy, name", "wait_s", "wait"))
def run_wait_avg_std(spark, folder):
    return rounded(ops.run_wait_avg_std(_runs(spark, folder)), "wait_std")


@query("wait_avg", f"""SELECT strategy, experiment, round(wait_avg, 6) AS wait_avg,
    CAST(format('{{:.2f}}', wait_avg) AS DOUBLE) AS wait_avg_2dp FROM ({WAIT_AVG_SQL}) AS w""")
def wait_avg(spark, folder):
    return rounded(ops.wait_avg(_runs(spark, folder)), "wait_avg")


@query("wait_avg_multi", stats_sql(WAIT_AVG_SQL, "strategy", "wait_avg", "wait", digits="6"))
def wait_avg_multi(spark, folder):
    return rounded(ops.wait_avg_multi(_runs(spark, folder)), "wait_avg", "wait_std")


PER_STRATEGY_SQL = f"SELECT strategy, avg(makespan_s) AS t FROM ({MAKESPAN_SQL}) AS m GROUP BY strategy"


@query("reduction_pct", f"""WITH times AS ({PER_STRATEGY_SQL}),
    main AS (SELECT t AS m FROM times WHERE strategy = '{MAIN}')
    SELECT strategy, round((m - t) / t * 100, 6) AS reduction,
           CAST(format('{{:.2f}}', (m - t) / t * 100) AS DOUBLE) AS reduction_2dp
    FROM times, main WHERE strategy <> '{MAIN}'""")
def reduction_pct(spark, folder):
    times = ops.makespan_avg_std(_runs(spark, folder))
    return rounded(ops.reduction_pct(times, MAIN, "makespan_avg"), "reduction")


@query("speedup_ratio", f"""WITH times AS ({PER_STRATEGY_SQL}),
    main AS (SELECT t AS m FROM times WHERE strategy = '{MAIN}')
    SELECT strategy, round(t / m, 6) AS speedup, CAST(format('{{:.2f}}', t / m) AS DOUBLE) AS speedup_2dp
    FROM times, main WHERE strategy <> '{MAIN}'""")
def speedup_ratio(spark, folder):
    times = ops.makespan_avg_std(_runs(spark, folder))
    return rounded(ops.speedup_ratio(times, MAIN, "makespan_avg"), "speedup")


@query("kfp_makespan", f"SELECT strategy, experiment, us / 1e6 AS makespan_s FROM ({KFP_SPAN_SQL}) AS s")
def kfp_makespan(spark, folder):
    return ops.external_makespan(_runs(spark, folder))


@query("kfp_makespan_avg_std", stats_sql(KFP_SPAN_SQL, "strategy", "us", "makespan", per="1e6"))
def kfp_makespan_avg_std(spark, folder):
    return rounded(ops.external_makespan_avg_std(_runs(spark, folder)), "makespan_std")


@query("kfp_exec_avg_std",
       stats_sql(f"SELECT strategy, name, {MICROS_EXEC} AS us FROM v_runs", "strategy, name", "us", "exec", per="1e6"))
def kfp_exec_avg_std(spark, folder):
    return rounded(ops.external_exec_avg_std(_runs(spark, folder)), "exec_std")


@query("population_std", """SELECT event_type, round(coalesce(stddev_pop(value), 0), 6) AS std,
    CAST(format('{:.2f}', coalesce(stddev_pop(value), 0)) AS DOUBLE) AS std_2dp FROM events GROUP BY event_type""")
def population_std(spark, folder):
    return rounded(ops.population_std(table(spark, folder, "events"), ["event_type"], "value"), "std")


STRATEGY_TABLE_SQL = " UNION ALL ".join(
    [f"""SELECT '{s}' AS strategy, name, avg(exec_s) AS exec_avg FROM ({last_per_name(WHOLE_EXEC, 'exec_s')}) AS e
         WHERE strategy = '{s}' GROUP BY name""" for s in ("click", "error", "purchase", "signup")]
    + [f"SELECT 'view' AS strategy, name, avg({MICROS_EXEC}) / 1e6 AS exec_avg FROM v_runs WHERE strategy = 'view' GROUP BY name"]
)


@query("strategy_table",
       STRATEGY_TABLE_SQL)
def strategy_table(spark, folder):
    """Four own schedulers and one external one, whose times keep their fraction."""
    runs = _runs(spark, folder)
    own = ops.run_exec_avg_std(runs)
    schedulers = own.filter(F.col("strategy").isin("click", "error", "purchase", "signup"))
    external = ops.external_exec_avg_std(runs.filter(F.col("strategy") == "view"))
    parts = [(None, schedulers), ("view", external)]
    return ops.strategy_table(parts, "exec_avg")


COUNTER_LOG_SQL = """SELECT epoch_us(ts) / 1e6 AS timestamp,
    CASE WHEN event_type = 'error' THEN 'new_window' ELSE 'update' END AS type,
    CAST(user_id % 7 AS INTEGER) AS running_pipelines, CAST(event_id % 5 AS INTEGER) AS waiting_pipelines FROM events"""


def counter_log(spark, folder):
    """Events read as a counter log: `error` rows open a window, the rest are updates."""
    return table(spark, folder, "events").select(
        (micros(F.col("ts")) / F.lit(1e6)).alias("timestamp"),
        F.when(F.col("event_type") == "error", "new_window").otherwise("update").alias("type"),
        (F.col("user_id") % 7).cast("int").alias("running_pipelines"),
        (F.col("event_id") % 5).cast("int").alias("waiting_pipelines"),
    )


ELAPSED_SQL = f"""SELECT *, CAST(trunc(timestamp - (SELECT min(timestamp) FROM ({COUNTER_LOG_SQL}) AS l0)) AS BIGINT)
    AS elapsed_time FROM ({COUNTER_LOG_SQL}) AS l1"""


@query("elapsed_time", ELAPSED_SQL)
def elapsed_time(spark, folder):
    return ops.elapsed_time(counter_log(spark, folder))


@query("window_marks", f"SELECT elapsed_time FROM ({ELAPSED_SQL}) AS e WHERE type = 'new_window'")
def window_marks(spark, folder):
    return ops.window_marks(counter_log(spark, folder))


@query("plot_series", f"""WITH e AS ({ELAPSED_SQL})
    SELECT elapsed_time, 'running' AS series, CAST(running_pipelines AS BIGINT) AS value FROM e WHERE type = 'update'
    UNION ALL
    SELECT elapsed_time, 'waiting', CAST(waiting_pipelines AS BIGINT) FROM e WHERE type = 'update'
    UNION ALL
    SELECT elapsed_time, 'mark', NULL FROM e WHERE type = 'new_window'""")
def plot_series(spark, folder):
    return ops.plot_series(counter_log(spark, folder))


@query("strategy_summary", f"""WITH spans AS (SELECT strategy, avg(makespan_s) AS makespan_avg,
        stddev_pop(makespan_s) AS makespan_std FROM ({MAKESPAN_SQL}) AS m GROUP BY strategy),
    waits AS (SELECT strategy, avg(wait_avg) AS wait_avg, stddev_pop(wait_avg) AS wait_std
        FROM ({WAIT_AVG_SQL}) AS w GROUP BY strategy),
    both_times AS (SELECT * FROM spans LEFT JOIN waits USING (strategy)),
    main AS (SELECT makespan_avg AS m, wait_avg AS w FROM both_times WHERE strategy = '{MAIN}')
    SELECT strategy, round(makespan_avg, 6) AS makespan_avg, round(makespan_std, 6) AS makespan_std,
        CASE WHEN strategy <> '{MAIN}' THEN round((m - makespan_avg) / makespan_avg * 100, 6) END AS makespan_reduction,
        CASE WHEN strategy <> '{MAIN}' THEN round(makespan_avg / m, 6) END AS makespan_speedup,
        round(wait_avg, 6) AS wait_avg, round(wait_std, 6) AS wait_std,
        CASE WHEN strategy <> '{MAIN}' THEN round((w - wait_avg) / wait_avg * 100, 6) END AS wait_reduction,
        CASE WHEN strategy <> '{MAIN}' THEN round(wait_avg / w, 6) END AS wait_speedup
    FROM both_times, main""")
def strategy_summary(spark, folder):
    summary = ops.strategy_summary(_runs(spark, folder), MAIN)
    return rounded(summary, *[c for c in summary.columns if c != "strategy"])
