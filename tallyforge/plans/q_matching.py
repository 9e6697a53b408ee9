"""Queries that match tasks to nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import matching as ops
from tallyforge.operators.nodes import node_platform
from tallyforge.plans.q_effort import EFFORTS_SQL
from tallyforge.operators import effort
from tallyforge.plans.q_prep import md5_part
from tallyforge.plans.registry import query
from tallyforge.plans.views import view
from tallyforge.session import settle

LOADED_SQL = """SELECT n.*, coalesce(a.c, 0) AS load, memory_kb - memory_kb * memory_usage AS free_kb FROM v_nodes AS n
    LEFT JOIN (SELECT node_id, count(*) AS c FROM v_tasks GROUP BY node_id) AS a USING (node_id)"""
NEEDS_SQL = """SELECT pipeline_id, component, type AS phase, model, CASE WHEN type = 'preprocessing' THEN '*' ELSE model END AS rule, size_kb,
    CAST(size_kb * 2 AS DOUBLE) AS need_kb FROM v_tasks"""


def placed_tasks(spark, folder):
    """The task table of one query, written once: it is read as tasks, as assignments and as load."""
    return settle(view(spark, folder, "v_tasks").withColumnRenamed("type", "phase"))


def tasks(placed):
    return placed.select("pipeline_id", "component", "phase", "model", "size_kb")


def assignments(placed):
    return placed.select("pipeline_id", "component", "node_id")


def loaded_nodes(spark, folder, placed):
    return settle(ops.load_snapshot(view(spark, folder, "v_nodes"), assignments(placed)))


def candidates(spark, folder, placed):
    return ops.heuristic_candidates(loaded_nodes(spark, folder, placed), ops.heuristics_table(spark))


def _rule_values() -> str:
    """The heuristics as SQL rows (phase, model, worker_type, architecture, s1, s2)."""
    rows = []
    rules = {p: dict(m) for p, m in ops.HEURISTICS.items()}
    rules["preprocessing"] = {"*": {"worker_type": ops.PREPROCESSING_CLASSES, "sorting": ops.PREPROCESSING_SORTING}}
    for phase, models in rules.items():
        for model, rule in models.items():
            s1, s2 = (rule.get("sorting", []) + ["none", "none"])[:2]
            rows += [f"('{phase}', '{model}', '{w}', '{a}', '{s1}', '{s2}')" for w in rule["worker_type"] for a in rule.get("architecture", ["*"])]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS r(phase, model, worker_type, arch, s1, s2)"


SORT_CASE = "CASE {0} WHEN 'memory' THEN memory_kb WHEN 'cpu_cores' THEN cpu_cores WHEN 'n_cpu_flags' THEN n_cpu_flags ELSE 0 END"
CANDIDATES_SQL = f"""SELECT r.phase, r.model, n.*, {SORT_CASE.format('s1')} AS sort1, {SORT_CASE.format('s2')} AS sort2
    FROM ({_rule_values()}) AS r JOIN ({LOADED_SQL}) AS n ON r.worker_type = n.worker_type AND r.arch IN ('*', n.architecture)"""


@query("load_snapshot", f"SELECT node_id, node, load FROM ({LOADED_SQL}) AS n")
def load_snapshot(spark, folder):
    return ops.load_snapshot(view(spark, folder, "v_nodes"), view(spark, folder, "v_tasks")).select("node_id", "node", "load")


@query("memory_feasible", f"""WITH t AS ({NEEDS_SQL}), n AS ({LOADED_SQL}),
    needs AS (SELECT need_kb, (SELECT count(*) FROM n WHERE free_kb > need_kb) AS n_feasible
              FROM (SELECT DISTINCT need_kb FROM t) AS d)
    SELECT pipeline_id, component, size_kb, n_feasible FROM t JOIN needs USING (need_kb)""")
def memory_feasible(spark, folder):
    counted = ops.memory_feasible(tasks(placed_tasks(spark, folder)), view(spark, folder, "v_nodes"))
    return counted.select("pipeline_id", "component", "size_kb", "n_feasible")


SIZES_SQL = """SELECT pipeline_id, train_percentage, test_percentage, n_samples * n_features * 8 // 1024 AS original_kb,
    n_samples * (n_features + CASE WHEN pipeline_id % 2 = 0 THEN 2 ELSE -2 END) * 8 // 1024 AS prepared_kb FROM v_catalog"""


def sizes(spark, folder):
    """Eight bytes a value; preparation adds or drops two columns."""
    change = F.when(F.col("pipeline_id") % 2 == 0, 2).otherwise(-2)
    return view(spark, folder, "v_catalog").select(
        "pipeline_id", "train_percentage", "test_percentage",
        F.expr("n_samples * n_features * 8 div 1024").alias("original_kb"),
        F.floor(F.col("n_samples") * (F.col("n_features") + change) * 8 / 1024).alias("prepared_kb"),
    )


@query("preprocessing_size", f"SELECT pipeline_id, greatest(original_kb, prepared_kb) AS size_kb FROM ({SIZES_SQL}) AS s")
def preprocessing_size(spark, folder):
    return sizes(spark, folder).select(
        "pipeline_id", ops.preprocessing_size(F.col("original_kb"), F.col("prepared_kb")).alias("size_kb"))


@query("phase_size", f"""SELECT pipeline_id, CAST(trunc(CAST(prepared_kb AS DOUBLE) * train_percentage) AS BIGINT) AS train_kb,
    CAST(trunc(CAST(prepared_kb AS DOUBLE) * test_percentage) AS BIGINT) AS test_kb FROM ({SIZES_SQL}) AS s""")
def phase_size(spark, folder):
    prepared = F.col("prepared_kb").cast("double")
    return sizes(spark, folder).select(
        "pipeline_id", ops.phase_size(prepared, F.col("train_percentage")).alias("train_kb"),
        ops.phase_size(prepared, F.col("test_percentage")).alias("test_kb"))


@query("heuristic_candidates", f"SELECT phase, model, node, load, sort1, sort2 FROM ({CANDIDATES_SQL}) AS c")
def heuristic_candidates(spark, folder):
    return candidates(spark, folder, placed_tasks(spark, folder)).select("phase", "model", "node", "load", "sort1", "sort2")


# One row per distinct need keeps the SQL's inequality join small; every task gets its answer.
DISTINCT_NEEDS = "SELECT DISTINCT phase, rule, need_kb FROM t"


@query("least_loaded_top1", f"""WITH t AS ({NEEDS_SQL}), c AS ({CANDIDATES_SQL}),
    best AS (SELECT d.phase, d.rule, d.need_kb, min((c.load, c.sort1, c.sort2, c.node)) AS b
             FROM ({DISTINCT_NEEDS}) AS d JOIN c ON c.phase = d.phase AND c.model = d.rule AND c.free_kb > d.need_kb
             GROUP BY d.phase, d.rule, d.need_kb)
    SELECT pipeline_id, component, phase, model, size_kb, b[4] AS node, b[1] AS load
    FROM t LEFT JOIN best USING (phase, rule, need_kb)""")
def least_loaded_top1(spark, folder):
    placed = placed_tasks(spark, folder)
    return ops.least_loaded_top1(tasks(placed), candidates(spark, folder, placed))


AFFINITY_SQL = f"""WITH t AS ({NEEDS_SQL}), c AS ({CANDIDATES_SQL}),
    used AS (SELECT DISTINCT pipeline_id, node_id FROM v_tasks),
    near AS (SELECT t.pipeline_id, t.component, min((c.load, c.sort1, c.sort2, c.node)) AS b
             FROM t JOIN used AS u ON u.pipeline_id = t.pipeline_id
             JOIN c ON c.node_id = u.node_id AND c.phase = t.phase AND c.model = t.rule AND c.free_kb > t.need_kb
             GROUP BY t.pipeline_id, t.component),
    best AS (SELECT d.phase, d.rule, d.need_kb, min((c.load, c.sort1, c.sort2, c.node)) AS b
             FROM ({DISTINCT_NEEDS}) AS d JOIN c ON c.phase = d.phase AND c.model = d.rule AND c.free_kb > d.need_kb
             GROUP BY d.phase, d.rule, d.need_kb)
    SELECT t.pipeline_id, t.component, t.phase, t.model, t.size_kb, coalesce(near.b[4], best.b[4]) AS node,
        near.b IS NOT NULL AS affine
    FROM t LEFT JOIN near ON near.pipeline_id = t.pipeline_id AND near.component = t.component
    LEFT JOIN best ON best.phase = t.phase AND best.rule = t.rule AND best.need_kb = t.need_kb"""


@query("affinity_top1", AFFINITY_SQL)
def affinity_top1(spark, folder):
    placed = placed_tasks(spark, folder)
    return ops.affinity_top1(tasks(placed), candidates(spark, folder, placed), assignments(placed))


ACTIVE_SQL = "SELECT DISTINCT pipeline_id FROM v_tasks WHERE type = 'preprocessing' AND pipeline_id % 3 = 0"


@query("fallback_node", f"""WITH t AS ({NEEDS_SQL}), c AS ({CANDIDATES_SQL}), n AS ({LOADED_SQL}), active AS ({ACTIVE_SQL}),
    best AS (SELECT d.phase, d.rule, d.need_kb, min((c.load, c.sort1, c.sort2, c.node)) AS b
             FROM ({DISTINCT_NEEDS}) AS d JOIN c ON c.phase = d.phase AND c.model = d.rule AND c.free_kb > d.need_kb
             GROUP BY d.phase, d.rule, d.need_kb),
    spare AS (SELECT min((load, node)) AS s FROM n WHERE worker_type = 'high-cpu')
    SELECT t.pipeline_id, t.component, t.phase, t.model, t.size_kb,
        CASE WHEN best.b IS NULL AND active.pipeline_id IS NULL THEN spare.s[2] ELSE best.b[4] END AS node, best.b[1] AS load
    FROM t LEFT JOIN best USING (phase, rule, need_kb) LEFT JOIN active ON active.pipeline_id = t.pipeline_id, spare""")
def fallback_node(spark, folder):
    """Every third pipeline counts as already placed, so only the others fall back."""
    placed = placed_tasks(spark, folder)
    nodes = loaded_nodes(spark, folder, placed)
    chosen = ops.least_loaded_top1(tasks(placed), ops.heuristic_candidates(nodes, ops.heuristics_table(spark)))
    return ops.fallback_node(chosen, nodes, placed.filter("phase = 'preprocessing' AND pipeline_id % 3 = 0"))


@query("accelerator_score_top1", f"""WITH c AS ({CANDIDATES_SQL}),
    best AS (SELECT phase, model, min((load - CASE WHEN accelerator <> 'none' THEN 3 ELSE 0 END, load, node)) AS b
             FROM c GROUP BY phase, model)
    SELECT pipeline_id, component, phase, model, size_kb, b[3] AS node, -b[1] AS score
    FROM ({NEEDS_SQL}) AS t LEFT JOIN best USING (phase, model) WHERE phase = 'training' AND model IN ('nn', 'cnn')""")
def accelerator_score_top1(spark, folder):
    placed = placed_tasks(spark, folder)
    networks = tasks(placed).filter((F.col("phase") == "training") & F.col("model").isin(ops.ACCELERATED_MODELS))
    return ops.accelerator_score_top1(networks, candidates(spark, folder, placed))


@query("greedy_top1", f"""WITH t AS ({NEEDS_SQL}), n AS ({LOADED_SQL}),
    best AS (SELECT need_kb, min((load, -cpu_cores, -memory_kb, node)) AS b
             FROM (SELECT DISTINCT need_kb FROM t) AS d JOIN n ON n.free_kb > d.need_kb GROUP BY need_kb)
    SELECT pipeline_id, component, phase, model, size_kb, b[4] AS node FROM t LEFT JOIN best USING (need_kb)""")
def greedy_top1(spark, folder):
    placed = placed_tasks(spark, folder)
    return ops.greedy_top1(tasks(placed), loaded_nodes(spark, folder, placed))


@query("random_feasible", f"""WITH t AS ({NEEDS_SQL}), n AS ({LOADED_SQL}),
    ranked AS (SELECT node, row_number() OVER (ORDER BY free_kb DESC, node_id) - 1 AS pick FROM n),
    counted AS (SELECT need_kb, (SELECT count(*) FROM n WHERE free_kb > need_kb) AS n_feasible
                FROM (SELECT DISTINCT need_kb FROM t) AS d),
    drawn AS (SELECT t.*, n_feasible, CASE WHEN n_feasible > 0 THEN
                {md5_part("concat(pipeline_id, '|', component, '|42')")} % n_feasible END AS pick
              FROM t JOIN counted USING (need_kb))
    SELECT pipeline_id, component, phase, model, size_kb, n_feasible, node FROM drawn LEFT JOIN ranked USING (pick)""")
def random_feasible(spark, folder):
    return ops.random_feasible(tasks(placed_tasks(spark, folder)), view(spark, folder, "v_nodes"), ["pipeline_id", "component"])


@query("random_order", f"""SELECT pipeline_id,
    row_number() OVER (ORDER BY {md5_part("concat(pipeline_id, '|42')")}, pipeline_id) AS position FROM v_catalog""")
def random_order(spark, folder):
    return ops.random_order(view(spark, folder, "v_catalog").select("pipeline_id"), "pipeline_id")


@query("fifo_order", """SELECT pipeline_id, strftime(submitted_at, '%Y-%m') AS submission_window,
    row_number() OVER (PARTITION BY strftime(submitted_at, '%Y-%m') ORDER BY submitted_at, pipeline_id) AS position
    FROM v_catalog""")
def fifo_order(spark, folder):
    month = F.date_format("submitted_at", "yyyy-MM").alias("submission_window")
    batch = view(spark, folder, "v_catalog").select("pipeline_id", month, "submitted_at")
    return ops.fifo_order(batch, "submission_window", "submitted_at", "pipeline_id").drop("submitted_at")


@query("placement_summary", f"""WITH t AS ({NEEDS_SQL}), n AS ({LOADED_SQL}), e AS ({EFFORTS_SQL}),
    best AS (SELECT need_kb, min((load, -cpu_cores, -memory_kb, node)) AS b
             FROM (SELECT DISTINCT need_kb FROM t) AS d JOIN n ON n.free_kb > d.need_kb GROUP BY need_kb)
    SELECT b[4] AS node, CASE WHEN accelerator <> 'none' THEN accelerator ELSE architecture END AS platform,
        count(*) AS n_tasks, CAST(sum(size_kb) AS BIGINT) AS size_kb, round(sum(effort) / 1e9, 3) AS giga_effort
    FROM t LEFT JOIN best USING (need_kb) LEFT JOIN n ON n.node = b[4]
    LEFT JOIN e ON e.pipeline_id = t.pipeline_id AND e.type = t.phase GROUP BY ALL""")
def placement_summary(spark, folder):
    stored = placed_tasks(spark, folder)
    nodes = loaded_nodes(spark, folder, stored)
    placed = ops.greedy_top1(tasks(stored), nodes)
    platforms = nodes.select("node", node_platform(F.col("accelerator"), F.col("architecture")).alias("platform"))
    efforts = effort.flat_task_efforts(view(spark, folder, "v_catalog")).withColumnRenamed("type", "phase")
    joined = placed.join(platforms, "node", "left").join(efforts, ["pipeline_id", "phase"], "left")
    summary = ops.placement_summary(joined, ["node", "platform"])
    # Sums near 1e16 differ in their last bits between engines; shown in units of 1e9.
    return summary.withColumn("giga_effort", F.round(F.col("effort") / 1e9, 3)).drop("effort")
