"""Queries over run state, nodes and datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import datasets, nodes
from tallyforge.operators import telemetry as ops
from tallyforge.plans.q_runlog import rounded
from tallyforge.plans.registry import query
from tallyforge.plans.views import view
from tallyforge.sources.tables import table

# --- run state ------------------------------------------------------------------------

REPORTED_SQL = """SELECT run_id, scheduled_at, CASE WHEN run_id % 7 = 0 THEN TIMESTAMP '1970-01-01 00:00:00'
    WHEN run_id % 11 = 0 THEN submitted_at ELSE finished_at END AS finished_at FROM v_runs"""


def _duration_sql(start: str, end: str) -> str:
    seconds = f"(epoch_us({end}) - epoch_us({start})) / 1e6"
    return f"CASE WHEN {seconds} >= 0 THEN CAST(format('{{:.2f}}', {seconds}) AS DOUBLE) END"


@query("normalize_run", f"""SELECT run_id, scheduled_at, CASE WHEN epoch_us(finished_at) > 0 THEN finished_at END AS finished_at,
    {_duration_sql('scheduled_at', 'finished_at')} AS duration FROM ({REPORTED_SQL}) AS r""")
def normalize_run(spark, folder):
    """Some runs report the epoch as their end, some an end before their start."""
    run = F.col("run_id")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    end = F.when(run % 7 == 0, epoch).when(run % 11 == 0, F.col("submitted_at")).otherwise(F.col("finished_at"))
    return ops.normalize_run(view(spark, folder, "v_runs").select("run_id", "scheduled_at", end.alias("finished_at")))


DETAILS_SQL = """SELECT l_orderkey AS pipeline_id, concat('c', l_linenumber) AS component, l_shipdate AS start_time,
    CASE WHEN l_quantity < 5 THEN TIMESTAMP '1970-01-01 00:00:00'
         ELSE l_shipdate + to_microseconds(CAST(floor(l_extendedprice * 100) AS BIGINT)) END AS end_time FROM lineitem"""
KNOWN_SQL = "SELECT o_orderkey AS pipeline_id, concat('c', k) AS component FROM orders, unnest(range(1, 6)) AS t(k)"


def task_details(spark, folder):
    micro = F.make_dt_interval(secs=F.floor(F.col("l_extendedprice") * 100) / F.lit(1000000).cast("decimal(18,6)"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("pipeline_id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("component"),
        F.col("l_shipdate").alias("start_time"),
        F.when(F.col("l_quantity") < 5, epoch).otherwise(F.col("l_shipdate") + micro).alias("end_time"),
    )


@query("normalize_task", f"""SELECT pipeline_id, component, start_time, CASE WHEN epoch_us(end_time) > 0 THEN end_time END AS end_time,
    {_duration_sql('start_time', 'end_time')} AS duration FROM ({DETAILS_SQL}) AS d
    WHERE (pipeline_id, component) IN (SELECT pipeline_id, component FROM ({KNOWN_SQL}) AS k)""")
def normalize_task(spark, folder):
    """Components c1..c5 are known, reports of c6 and c7 are dropped."""
    known = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pipeline_id"), F.explode(F.array(*[F.lit(f"c{i}") for i in range(1, 6)])).alias("component"))
    return ops.normalize_task(task_details(spark, folder), known)


@query("latest_run_by_id", """SELECT user_id AS run_id, event_type AS state, ts AS updated_at FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_run_by_id(spark, folder):
    return ops.latest_run_by_id(state_updates(table(spark, folder, "events")))


def state_updates(events):
    return events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("state"),
                         F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))


PIPELINES_SQL = """SELECT p_partkey AS pipeline_id,
    concat(replace(p_name, ' ', '_'), CASE WHEN p_partkey % 3 = 0 THEN concat('_', p_size) ELSE '' END) AS name FROM part"""


@query("prefix_match_run", f"""WITH p AS ({PIPELINES_SQL}),
    r AS (SELECT p_partkey AS run_id, concat(replace(p_name, ' ', '-'), '-', p_size, ' ', p_partkey) AS display_name FROM part),
    n AS (SELECT DISTINCT name, replace(lower(name), '_', '-') AS prefix FROM p),
    m AS (SELECT name, max(run_id) AS run_id FROM n JOIN r ON starts_with(display_name, prefix) GROUP BY name)
    SELECT pipeline_id, name, run_id FROM p LEFT JOIN m USING (name)""")
def prefix_match_run(spark, folder):
    part = table(spark, folder, "part")
    suffix = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise("")
    pipelines = part.select(F.col("p_partkey").alias("pipeline_id"), F.concat(F.translate("p_name", " ", "_"), suffix).alias("name"))
    shown = F.concat(F.translate("p_name", " ", "-"), F.lit("-"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_partkey").cast("string"))
    runs = part.select(F.col("p_partkey").alias("run_id"), shown.alias("display_name"), F.col("p_partkey").alias("seq"))
    return ops.prefix_match_run(pipelines, runs)


WINDOW = "1 hour"


@query("submission_windows", """WITH w AS (SELECT run_id, date_trunc('hour', submitted_at) AS window_start FROM v_runs)
    SELECT run_id, window_start, dense_rank() OVER (ORDER BY window_start) AS time_window FROM w""")
def submission_windows(spark, folder):
    return ops.submission_windows(view(spark, folder, "v_runs"), WINDOW).select("run_id", "window_start", "time_window")


@query("running_waiting_counts", """WITH c AS (SELECT submitted_at AS ts, 0 AS r, 1 AS w FROM v_runs
        UNION ALL SELECT scheduled_at, 1, -1 FROM v_runs UNION ALL SELECT finished_at, -1, 0 FROM v_runs),
    s AS (SELECT ts, sum(r) AS r, sum(w) AS w FROM c WHERE ts IS NOT NULL GROUP BY ts)
    SELECT ts, CAST(sum(r) OVER (ORDER BY ts) AS BIGINT) AS running, CAST(sum(w) OVER (ORDER BY ts) AS BIGINT) AS waiting FROM s""")
def running_waiting_counts(spark, folder):
    return ops.running_waiting_counts(view(spark, folder, "v_runs"))


STATE_SQL = "CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END"


@query("terminal_runs", f"""SELECT event_id AS run_id, {STATE_SQL} AS state FROM events
    WHERE {STATE_SQL} IN ('SUCCEEDED', 'FAILED')""")
def terminal_runs(spark, folder):
    state = F.when(F.col("event_type") == "purchase", "SUCCEEDED").when(F.col("event_type") == "error", "FAILED").otherwise("RUNNING")
    return ops.terminal_runs(table(spark, folder, "events").select(F.col("event_id").alias("run_id"), state.alias("state")))


TASK_STATE_SQL = "CASE WHEN component % 5 = 0 THEN 'FAILED' WHEN component = 7 THEN NULL ELSE 'SUCCEEDED' END"


def stated_tasks(spark, folder):
    component = F.col("component")
    state = F.when(component % 5 == 0, "FAILED").when(component == 7, None).otherwise("SUCCEEDED")
    return view(spark, folder, "v_tasks").withColumn("state", state)


@query("node_release_times", f"""SELECT pipeline_id, node_id, max(end_time) AS released_at FROM v_tasks GROUP BY pipeline_id, node_id
    HAVING bool_and(coalesce({TASK_STATE_SQL} = 'SUCCEEDED', false))""")
def node_release_times(spark, folder):
    return ops.node_release_times(stated_tasks(spark, folder))


ACTIVE_SQL = f"SELECT pipeline_id, component, node_id FROM v_tasks WHERE coalesce({TASK_STATE_SQL}, '') <> 'SUCCEEDED'"


def _active(spark, folder):
    tasks = stated_tasks(spark, folder)
    return ops.active_assignments(tasks.select("pipeline_id", "component", "node_id"), tasks)


@query("active_assignments", ACTIVE_SQL)
def active_assignments(spark, folder):
    return _active(spark, folder)


@query("still_needed_nodes", f"SELECT DISTINCT pipeline_id, node_id FROM ({ACTIVE_SQL}) AS a")
def still_needed_nodes(spark, folder):
    pairs = view(spark, folder, "v_tasks").select("pipeline_id", "node_id").distinct()
    return ops.still_needed_nodes(pairs, _active(spark, folder))


@query("ready_pipelines", """SELECT pipeline_id FROM v_tasks LEFT JOIN (SELECT node_id FROM v_nodes WHERE node_id % 10 = 0) AS b
    USING (node_id) GROUP BY pipeline_id HAVING count(b.node_id) = 0""".replace("USING (node_id)", "ON b.node_id = v_tasks.node_id"))
def ready_pipelines(spark, folder):
    """Every tenth node is occupied."""
    occupied = F.when(F.col("node_id") % 10 == 0, F.lit(1))
    occupation = view(spark, folder, "v_nodes").select("node_id", occupied.alias("occupant"))
    return ops.ready_pipelines(view(spark, folder, "v_tasks").select("pipeline_id", "node_id"), occupation)


@query("run_lookup", "SELECT * FROM v_catalog WHERE pipeline_id = 77")
def run_lookup(spark, folder):
    return ops.run_lookup(view(spark, folder, "v_catalog"), "pipeline_id", 77)


@query("task_durations", """SELECT type, node_id, CASE WHEN accelerator <> 'none' THEN accelerator ELSE architecture END AS platform,
    count(*) AS n_tasks, round(avg(s), 6) AS avg_s, min(s) AS min_s, max(s) AS max_s
    FROM (SELECT *, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 AS s FROM v_tasks) AS t JOIN v_nodes AS n USING (node_id)
    WHERE s >= 0 GROUP BY ALL""")
def task_durations(spark, folder):
    platform = nodes.node_platform(F.col("accelerator"), F.col("architecture"))
    platforms = view(spark, folder, "v_nodes").select("node_id", platform.alias("platform"))
    tasks = view(spark, folder, "v_tasks").join(platforms, "node_id")
    return rounded(ops.task_durations(tasks, ["type", "node_id", "platform"]), "avg_s")


# --- nodes ----------------------------------------------------------------------------

def metrics(spark, folder):
    """Gauges in bytes."""
    return view(spark, folder, "v_metrics").withColumn("value", F.col("value") * 1e6)


def _sliding(inner: str, value: str, out: str) -> str:
    return f"""SELECT node_id, w AS window_start, w + INTERVAL 5 MINUTE AS window_end,
        CAST(round(avg({value}) / 1024) AS BIGINT) AS {out}
    FROM (SELECT *, date_trunc('minute', ts) - to_minutes(k) AS w FROM ({inner}) AS g, unnest(range(0, 5)) AS t(k)) AS e
    GROUP BY node_id, w"""


FREE_SQL = _sliding("SELECT node_id, ts, value * 1e6 AS value FROM v_metrics", "value", "free_kb")
OWN_SQL = _sliding("""SELECT node_id, ts, sum(value * 1e6) AS total FROM v_metrics
    WHERE namespace = 'kubeflow' AND container <> '' GROUP BY node_id, ts""", "total", "used_kb")


@query("free_memory_avg", FREE_SQL)
def free_memory_avg(spark, folder):
    return nodes.free_memory_avg(metrics(spark, folder))


@query("namespace_memory_avg", OWN_SQL)
def namespace_memory_avg(spark, folder):
    return nodes.namespace_memory_avg(metrics(spark, folder))


@query("memory_usage_ratio", f"""WITH f AS (SELECT node_id, arg_max(free_kb, window_end) AS free_kb FROM ({FREE_SQL}) AS a GROUP BY node_id),
    u AS (SELECT node_id, arg_max(used_kb, window_end) AS used_kb FROM ({OWN_SQL}) AS b GROUP BY node_id),
    r AS (SELECT node_id, CAST(memory_kb - coalesce(free_kb, 0) - coalesce(used_kb, 0) AS DOUBLE) / nullif(memory_kb, 0) AS memory_usage
          FROM v_nodes LEFT JOIN f USING (node_id) LEFT JOIN u USING (node_id))
    SELECT node_id, memory_usage, CAST(format('{{:.2f}}', memory_usage) AS DOUBLE) AS memory_usage_2dp FROM r""")
def memory_usage_ratio(spark, folder):
    gauges = metrics(spark, folder)
    free = nodes.latest_window(nodes.free_memory_avg(gauges), "free_kb")
    own = nodes.latest_window(nodes.namespace_memory_avg(gauges), "used_kb")
    return nodes.memory_usage_ratio(view(spark, folder, "v_nodes"), free, own)


@query("ready_workers", """SELECT s_suppkey AS node_id FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0""")
def ready_workers(spark, folder):
    """A third of the nodes are servers, a quarter report Ready = 'False'."""
    key = F.col("s_suppkey")
    ready = F.when(key % 4 == 0, "False").otherwise("True")
    conditions = F.array(F.struct(F.lit("MemoryPressure").alias("type"), F.lit("True").alias("status")),
                         F.struct(F.lit("Ready").alias("type"), ready.alias("status")))
    described = table(spark, folder, "supplier").select(
        key.alias("node_id"), F.when(key % 3 == 0, '["server"]').otherwise('["agent","--token"]').alias("node_args"),
        conditions.alias("conditions"))
    return nodes.ready_workers(described).select("node_id")


@query("parse_quantity", "SELECT node_id, memory_kb FROM v_nodes")
def parse_quantity(spark, folder):
    quantity = view(spark, folder, "v_nodes").select("node_id", F.concat(F.col("memory_kb").cast("string"), F.lit("Ki")).alias("q"))
    return quantity.select("node_id", nodes.parse_quantity(F.col("q")).alias("memory_kb"))


@query("node_filter_sort", """SELECT * FROM v_nodes WHERE worker_type IN ('low', 'med') AND architecture = 'amd64'
    ORDER BY cpu_cores, memory_kb""")
def node_filter_sort(spark, folder):
    wanted = {"worker_type": ["low", "med"], "architecture": "amd64"}
    return nodes.node_filter_sort(view(spark, folder, "v_nodes"), wanted, ["cpu_cores", "memory_kb"])


@query("node_platform", """SELECT node, CASE WHEN accelerator <> 'none' THEN accelerator ELSE architecture END AS platform
    FROM v_nodes""")
def node_platform(spark, folder):
    platform = nodes.node_platform(F.col("accelerator"), F.col("architecture"))
    return view(spark, folder, "v_nodes").select("node", platform.alias("platform"))


# --- datasets -------------------------------------------------------------------------

@query("dataset_registry")
def dataset_registry(spark, folder):
    """The tables of the folder themselves, by their file listing."""
    return datasets.dataset_registry(spark, folder)


ENTRY_SQL = "concat(event_type, '-', user_id)"


@query("registry_refresh", f"""SELECT {ENTRY_SQL} AS name, props AS path, CAST(floor(value) AS BIGINT) AS size_kb, ts AS modified_at
    FROM events QUALIFY row_number() OVER (PARTITION BY {ENTRY_SQL} ORDER BY ts DESC, (value < 50) DESC, props DESC,
    CAST(floor(value) AS BIGINT) DESC) = 1""")
def registry_refresh(spark, folder):
    """Small events are the registered entries, large ones were found by a new listing."""
    entries = table(spark, folder, "events").select(
        F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("name"), F.col("props").alias("path"),
        F.floor("value").alias("size_kb"), F.col("ts").alias("modified_at"), "value")
    return datasets.registry_refresh(entries.filter("value < 50"), entries.filter("NOT value < 50"))


@query("array_size_kb", """SELECT pipeline_id, n_samples * (8 * n_features + 4 * 3 + 1 * 2) // 1024 AS size_kb FROM v_catalog""")
def array_size_kb(spark, folder):
    types = F.create_map(F.lit("float64"), F.col("n_features"), F.lit("int32"), F.lit(3).cast("bigint"), F.lit("uint8"), F.lit(2).cast("bigint"))
    return view(spark, folder, "v_catalog").select("pipeline_id", datasets.array_size_kb(F.col("n_samples"), types).alias("size_kb"))


@query("size_in_memory", """SELECT pipeline_id, CASE WHEN pipeline_id % 2 = 0 THEN n_samples * 8 * n_features // 1024
    ELSE CAST(p_size AS BIGINT) * CASE WHEN pipeline_id % 4 = 1 THEN 1 ELSE 8 END END AS size_kb
    FROM v_catalog LEFT JOIN part ON p_partkey = pipeline_id""")
def size_in_memory(spark, folder):
    """Odd pipelines are images, whose registry entry may be missing."""
    key = F.col("pipeline_id")
    described = view(spark, folder, "v_catalog").select(
        key, F.concat(F.lit("d"), key.cast("string")).alias("name"), F.when(key % 2 == 0, "tabular").otherwise("image").alias("type"),
        (key % 4 == 1).alias("normalized"), "n_samples", F.create_map(F.lit("float64"), F.col("n_features")).alias("data_types"))
    registry = table(spark, folder, "part").select(
        F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("bigint").alias("size_kb"))
    return datasets.size_in_memory(described, registry).select("pipeline_id", "size_kb")


@query("table_profile", """SELECT count(*) AS n_samples, 7 AS n_features, count(DISTINCT label) AS n_classes, t.data_type, t.n_columns
    FROM v_tab, (VALUES ('object', 3), ('float64', 4), ('int32', 1)) AS t(data_type, n_columns) GROUP BY t.data_type, t.n_columns""")
def table_profile(spark, folder):
    return datasets.table_profile(view(spark, folder, "v_tab"), "label")
