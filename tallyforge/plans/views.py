"""Inputs of the operators, derived from the star-schema tables.

Each view has one SQL text used by both engines; `{table}` marks an input. `v_runs`
is the exception: its per-user numbering is planned with `exact_rank`, since one
user may own a large share of all events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.functions.ordered import exact_rank
from tallyforge.functions.timing import micros
from tallyforge.sources.tables import table

RUNS = """
SELECT CAST(user_id AS BIGINT) * 2147483648 + CAST(floor(rn / 3) AS BIGINT) AS run_id,
       CAST(floor(rn / 3) AS BIGINT) % 5 AS experiment,
       concat('p', CAST(user_id % 20 AS STRING)) AS name,
       max(CASE WHEN rn % 3 = 0 THEN event_type END) AS strategy,
       min(CASE WHEN rn % 3 = 0 THEN ts END) AS submitted_at,
       min(CASE WHEN rn % 3 = 1 THEN ts END) AS scheduled_at,
       min(CASE WHEN rn % 3 = 2 THEN ts END) AS finished_at
FROM (SELECT user_id, event_id, ts, event_type,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM {events}) AS numbered
GROUP BY user_id, CAST(floor(rn / 3) AS BIGINT)
"""

NODES = """
SELECT s_suppkey AS node_id, s_name AS node, CAST(floor(abs(s_acctbal)) AS BIGINT) * 10 AS memory_kb,
       CAST(s_suppkey % 10 AS DOUBLE) / 20 AS memory_usage,
       CASE s_suppkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'med' WHEN 2 THEN 'high-cpu' ELSE 'high-gpu' END AS worker_type,
       CASE WHEN s_suppkey % 11 = 5 THEN 'riscv64' WHEN s_nationkey % 3 = 0 THEN 'arm64' ELSE 'amd64' END AS architecture,
       2 + s_suppkey % 7 AS cpu_cores, 20 + s_suppkey % 11 AS n_cpu_flags,
       CASE WHEN s_suppkey % 4 = 3 THEN 'gpu' ELSE 'none' END AS accelerator
FROM {supplier}
"""

TASKS = """
SELECT l_orderkey AS pipeline_id, l_linenumber AS component, min(l_suppkey) AS node_id,
       CAST(floor(max(l_extendedprice) / 2) AS BIGINT) AS size_kb,
       CASE l_linenumber % 3 WHEN 1 THEN 'preprocessing' WHEN 2 THEN 'training' ELSE 'evaluation' END AS type,
       CASE l_orderkey % 7 WHEN 0 THEN 'logistic_regression' WHEN 1 THEN 'decision_tree' WHEN 2 THEN 'random_forest'
            WHEN 3 THEN 'svm' WHEN 4 THEN 'nn' WHEN 5 THEN 'cnn' ELSE 'linear_regression' END AS model,
       min(l_shipdate) AS start_time, max(l_shipdate) AS end_time
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

CATALOG = """
SELECT o_orderkey AS pipeline_id, CAST(floor(o_totalprice) AS BIGINT) AS n_samples,
       5 + o_custkey % 40 AS n_features, CAST(0.8 AS DOUBLE) AS train_percentage, CAST(0.2 AS DOUBLE) AS test_percentage,
       CASE o_orderkey % 6 WHEN 0 THEN 'logistic_regression' WHEN 1 THEN 'decision_tree' WHEN 2 THEN 'random_forest'
            WHEN 3 THEN 'svm' WHEN 4 THEN 'nn' ELSE 'linear_regression' END AS model_type,
       CASE WHEN o_custkey % 3 = 0 THEN 100 END AS n_iter,
       CASE WHEN o_orderkey % 6 = 1 AND o_custkey % 7 = 0 THEN NULL WHEN o_orderkey % 4 < 2 THEN 20 ELSE 10 END AS max_depth,
       CASE WHEN o_orderkey % 12 = 3 THEN 'rbf' ELSE 'linear' END AS kernel,
       CASE WHEN o_custkey % 2 = 0 THEN 7 END AS n_estimators, CASE WHEN o_custkey % 4 = 1 THEN 'sgd' END AS solver,
       CASE WHEN o_custkey % 4 = 3 THEN CAST(50 AS BIGINT) END AS support_vectors,
       CAST(1000 + o_custkey AS DOUBLE) AS macs, 10 AS n_epochs, o_orderdate AS submitted_at
FROM {orders}
"""

LAYERS = """
SELECT l_orderkey AS pipeline_id, l_linenumber AS layer, 'Dense' AS type,
       CAST(max(l_quantity) AS BIGINT) AS n_in, CAST(min(l_quantity) AS BIGINT) + 1 AS n_out
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

METRICS = """
SELECT ts, CAST(user_id % 10 AS BIGINT) AS node_id, event_type AS container,
       CASE WHEN event_type IN ('click', 'view') THEN 'kubeflow' ELSE 'other' END AS namespace, value
FROM {events}
"""

TAB = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-',
              CAST(l_suppkey AS STRING)) AS row_key,
       l_returnflag AS c1, l_linestatus AS c2, l_quantity AS x1, l_extendedprice AS x2, l_discount AS x3, l_tax AS x4,
       CASE WHEN l_extendedprice >= 30000 THEN 1 ELSE 0 END AS label
FROM {lineitem}
"""

SOURCES = {
    "v_runs": (RUNS, "events"),
    "v_nodes": (NODES, "supplier"),
    "v_tasks": (TASKS, "lineitem"),
    "v_catalog": (CATALOG, "orders"),
    "v_layers": (LAYERS, "lineitem"),
    "v_metrics": (METRICS, "events"),
    "v_tab": (TAB, "lineitem"),
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the `v_*` views over the tables in `folder`."""
    if name == "v_runs":
        return runs(table(spark, folder, "events"))
    text, source = SOURCES[name]
    return spark.sql(text, **{source: table(spark, folder, source)})


def runs(events: DataFrame) -> DataFrame:
    """Three consecutive events of a user are one run: submitted, scheduled, finished; the last may not have got so far."""
    slim = events.select("user_id", "event_id", "ts", "event_type", micros(F.col("ts")).alias("_us"))
    numbered = exact_rank(slim, ["user_id"], ["_us", "event_id"]).withColumn("_step", (F.col("rn") - 1) % 3)
    number = ((F.col("rn") - 1) / 3).cast("bigint")

    def at(step: int, value: str):
        return F.when(F.col("_step") == step, F.col(value))

    return (
        numbered.groupBy("user_id", number.alias("_n"))
        .agg(
            F.max(at(0, "event_type")).alias("strategy"),
            F.min(at(0, "ts")).alias("submitted_at"),
            F.min(at(1, "ts")).alias("scheduled_at"),
            F.min(at(2, "ts")).alias("finished_at"),
        )
        .select(
            (F.col("user_id").cast("bigint") * 2147483648 + F.col("_n")).alias("run_id"),
            (F.col("_n") % 5).alias("experiment"),
            F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("name"),
            "strategy", "submitted_at", "scheduled_at", "finished_at",
        )
    )


def with_views(sql: str) -> str:
    """Prefixes the view definitions an oracle text mentions."""
    parts = []
    for name, (text, source) in SOURCES.items():
        if name in sql:
            parts.append(f"{name} AS ({text.format(**{source: source}).strip()})")
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
