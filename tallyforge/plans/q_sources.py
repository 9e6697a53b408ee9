"""Queries over readers and writers.

The test tables are parquet, so each query first writes the format it reads, from the
whole table, into the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.plans.q_prep import SPLIT_SQL
from tallyforge.operators import prep
from tallyforge.plans.q_runlog import COUNTER_LOG_SQL, counter_log
from tallyforge.plans.registry import query
from tallyforge.plans.views import view
from tallyforge.session import scratch_path
from tallyforge.sources import files
from tallyforge.sources.tables import table


def _csv(spark, df, name, **options):
    path = scratch_path(spark, name)
    df.write.options(**options).csv(path)
    return path


@query("scan_csv", "SELECT * FROM customer")
def scan_csv(spark, folder):
    source = table(spark, folder, "customer")
    return files.read_csv(spark, _csv(spark, source, "csv", header=True), source.schema)


@query("scan_csv_sep", "SELECT * FROM part")
def scan_csv_sep(spark, folder):
    source = table(spark, folder, "part")
    return files.read_csv(spark, _csv(spark, source, "csv-sep", header=True, sep=";"), source.schema, sep=";")


@query("scan_csv_named", """SELECT o_orderkey AS duration, o_custkey AS service, o_orderstatus AS flag, o_totalprice AS rate,
    strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS label FROM orders""")
def scan_csv_named(spark, folder):
    """No header line: the names come from the schema."""
    names = "duration bigint, service bigint, flag string, rate double, day string, label string"
    source = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    return files.read_csv(spark, _csv(spark, source, "csv-named", header=False), names, header=False)


ARRAY_FILES_SQL = """WITH n AS (SELECT count(*) // 2000 + 1 AS shards FROM embeddings)
    SELECT concat('shard=', vec_id % shards) AS folder, row_number() OVER (PARTITION BY vec_id % shards ORDER BY vec_id) - 1 AS pos,
        CAST(len(embedding) AS INTEGER) AS width, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last
    FROM embeddings, n"""


def _array_files(spark, folder, reader):
    source, path = table(spark, folder, "embeddings"), scratch_path(spark, "npy")
    shards = source.count() // 2000 + 1
    files.write_npy(source.withColumn("shard", F.col("vec_id") % shards), path, "shard", "vec_id", "embedding")
    return reader(spark, path, "*.txt").select(
        "folder", "pos", F.size("values").alias("width"), F.get("values", F.lit(0)).alias("first"), F.element_at("values", -1).alias("last"))


@query("scan_array_files", ARRAY_FILES_SQL)
def scan_array_files(spark, folder):
    """Vectors written as array files of about 2000 rows and read back."""
    return _array_files(spark, folder, files.read_npy)


@query("scan_array_ranges", ARRAY_FILES_SQL)
def scan_array_ranges(spark, folder):
    """The same files, each read by as many tasks as it has blocks."""
    return _array_files(spark, folder, files.read_npy_ranges)


@query("scan_arrays", """SELECT vec_id AS idx, CAST(i AS INTEGER) AS pos, CAST(embedding[i + 1] AS DOUBLE) AS pixel, label
    FROM embeddings, unnest(range(0, len(embedding))) AS t(i)""")
def scan_arrays(spark, folder):
    source = table(spark, folder, "embeddings")
    x_path, y_path = scratch_path(spark, "x"), scratch_path(spark, "y")
    source.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("pixels")).write.parquet(x_path)
    source.select(F.col("vec_id").alias("idx"), "label").write.parquet(y_path)
    rows = files.read_arrays(spark, x_path, y_path)
    return rows.select("idx", F.posexplode("pixels").alias("pos", "pixel"), "label").withColumn("pixel", F.col("pixel").cast("double"))


def run_dump(spark, folder):
    """Runs in the layout of a dump, private columns included."""
    runs = view(spark, folder, "v_runs")
    names = ["data-preprocessing", "model-training", "model-evaluation"]
    types = ["preprocessing", "training", "evaluation"]

    def component(name, kind):
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit("SUCCEEDED").alias("state"),
                        F.concat(F.lit("node-"), (F.col("run_id") % 10).cast("string")).alias("node"), F.lit("amd64").alias("platform"),
                        files.text_time(F.col("scheduled_at")).alias("start_time"),
                        files.text_time(F.col("finished_at")).alias("end_time"))

    pairs = [x for n, k in zip(names, types) for x in (F.lit(n), component(n, k))]
    return runs.select(
        F.col("run_id").cast("string").alias("id"), "name", F.lit("SUCCEEDED").alias("state"),
        *[files.text_time(F.col(c)).alias(c) for c in ("submitted_at", "scheduled_at", "finished_at")],
        F.create_map(*pairs).alias("components"), "strategy", F.col("experiment").alias("seed"),
        F.lit(1.5).alias("effort"), F.current_timestamp().alias("last_update"), F.lit(1).alias("time_window"), F.lit("{}").alias("metadata"),
    )


def written_dump(spark, folder):
    path = scratch_path(spark, "runs")
    files.write_run_dump(run_dump(spark, folder), path)
    return path


def local_times(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("scan_runlogs", """SELECT strategy, CAST(experiment AS STRING) AS seed, CAST(run_id AS STRING) AS id, name,
    submitted_at, scheduled_at, finished_at FROM v_runs""")
def scan_runlogs(spark, folder):
    runs = files.read_run_dumps(spark, written_dump(spark, folder), multi_line=False)
    times = ["submitted_at", "scheduled_at", "finished_at"]
    return local_times(runs.select("strategy", "seed", "id", "name", *times), *times)


RUNLOGS_SQL = """SELECT strategy, CAST(experiment AS STRING) AS seed, CAST(run_id AS STRING) AS id, name,
    submitted_at, scheduled_at, finished_at FROM v_runs"""


def _array_dumps(spark, folder, **options):
    """Dumps that hold one JSON array per file, of about a thousand runs."""
    dump, path = run_dump(spark, folder), scratch_path(spark, "runs-arrays")
    body = F.to_json(F.struct(*[c for c in dump.columns if c not in ("strategy", "seed")]))
    n, groups = dump.agg(F.count(F.lit(1)), F.count_distinct("strategy", "seed")).first()
    parts = n // (1000 * max(1, groups)) + 1
    arrays = dump.groupBy("strategy", "seed", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("_part")).agg(F.collect_list(body).alias("_runs"))
    arrays.select("strategy", "seed", F.concat(F.lit("["), F.array_join("_runs", ",\n"), F.lit("]")).alias("value")) \
        .write.option("maxRecordsPerFile", 1).partitionBy("strategy", "seed").text(path)
    times = ["submitted_at", "scheduled_at", "finished_at"]
    return local_times(files.read_run_dumps(spark, path, **options).select("strategy", "seed", "id", "name", *times), *times)


@query("scan_runlogs_arrays", RUNLOGS_SQL)
def scan_runlogs_arrays(spark, folder):
    return _array_dumps(spark, folder)


@query("scan_runlogs_ranges", RUNLOGS_SQL)
def scan_runlogs_ranges(spark, folder):
    """The same dumps, cut at object borders within their files."""
    return _array_dumps(spark, folder, by_ranges=True)


@query("explode_components", """SELECT CAST(run_id AS STRING) AS id, c AS component, t AS type, concat('node-', run_id % 10) AS node
    FROM v_runs, (VALUES ('data-preprocessing', 'preprocessing'), ('model-training', 'training'), ('model-evaluation', 'evaluation')) AS k(c, t)""")
def explode_components(spark, folder):
    runs = files.read_run_dumps(spark, written_dump(spark, folder), multi_line=False)
    return files.explode_components(runs).select("id", "component", "type", "node")


@query("sink_run_dump", """SELECT CAST(run_id AS STRING) AS id, name, 'SUCCEEDED' AS state, strategy,
    CAST(experiment AS INTEGER) AS seed, strftime(submitted_at, '%Y-%m-%d %H:%M:%S.%f+00:00') AS submitted_at FROM v_runs""")
def sink_run_dump(spark, folder):
    """Reads the files back as they are: private columns must be gone, so they are not in the schema found."""
    back = spark.read.json(written_dump(spark, folder))
    leaked = set(files.PRIVATE_RUN_COLUMNS) & set(back.columns)
    if leaked:
        raise AssertionError(f"private columns in the dump: {sorted(leaked)}")
    return back.select("id", "name", "state", "strategy", "seed", "submitted_at")


@query("scan_kfp_runs", """SELECT CAST(run_id AS STRING) AS run_id, replace(concat(name, '-', strategy), '-', '_') AS name,
    submitted_at AS created_at, scheduled_at, finished_at, (epoch_us(finished_at) - epoch_us(scheduled_at)) / 1e6 AS duration FROM v_runs""")
def scan_kfp_runs(spark, folder):
    """Documents of at most 100 runs, as a paged API returns them."""
    runs = view(spark, folder, "v_runs")
    one = F.struct(
        F.col("run_id").cast("string").alias("run_id"),
        F.concat("name", F.lit("-"), "strategy", F.lit(" run of "), F.col("submitted_at").cast("string")).alias("display_name"),
        F.lit("SUCCEEDED").alias("state"), files.text_time(F.col("submitted_at")).alias("created_at"),
        files.text_time(F.col("scheduled_at")).alias("scheduled_at"), files.text_time(F.col("finished_at")).alias("finished_at"))
    pages = runs.groupBy(F.floor(F.col("run_id") / 100).alias("page")).agg(F.collect_list(one).alias("runs"))
    path = scratch_path(spark, "external")
    pages.select("runs").write.json(path)
    read = files.read_external_runs(spark, path, multi_line=False)
    times = ["created_at", "scheduled_at", "finished_at"]
    return local_times(read.select("run_id", "name", *times, "duration"), *times)


@query("scan_counter_log", COUNTER_LOG_SQL)
def scan_counter_log(spark, folder):
    path = scratch_path(spark, "counter")
    counter_log(spark, folder).write.option("header", True).csv(path)
    return files.read_counter_log(spark, path)


@query("sink_counter_log", COUNTER_LOG_SQL)
def sink_counter_log(spark, folder):
    """Appended in two calls; both must be there."""
    rows, path = counter_log(spark, folder), scratch_path(spark, "counter")
    files.append_counter_log(rows.filter("type = 'update'"), path)
    files.append_counter_log(rows.filter("type = 'new_window'"), path)
    return files.read_counter_log(spark, path)


def nested_catalog(spark, folder):
    flat = view(spark, folder, "v_catalog")
    version = F.struct("n_samples", F.col("n_features").cast("int").alias("n_features"), F.lit(2).alias("n_classes"),
                       F.create_map(F.lit("float64"), F.col("n_features").cast("int")).alias("data_types"))
    phases = ["preprocessing", "training", "evaluation"]
    types = F.create_map(*[x for p in phases for x in (F.lit(f"c-{p}"), F.lit(p))])
    return flat.select(
        F.col("pipeline_id").cast("string").alias("pipeline_id"), F.concat(F.lit("run "), F.col("pipeline_id").cast("string")).alias("name"),
        "submitted_at", types.alias("components_type"),
        F.struct(F.lit("d").alias("name"), F.lit("tabular").alias("type"), "train_percentage", F.lit(0.0).alias("val_percentage"),
                 "test_percentage", version.alias("original"), version.alias("preprocessed")).alias("dataset"),
        F.struct(F.col("model_type").alias("type"), F.struct(F.col("max_depth").cast("int").alias("max_depth"), F.col("n_iter").cast("int").alias("n_iter"), "kernel").alias("params")).alias("model"),
    )


def read_catalog(spark, folder):
    path = scratch_path(spark, "catalog")
    nested_catalog(spark, folder).write.json(path)
    return files.read_catalog(spark, path, multi_line=False)


@query("scan_catalog", """SELECT CAST(pipeline_id AS STRING) AS pipeline_id, n_samples, CAST(n_features AS INTEGER) AS n_features,
    model_type, CAST(max_depth AS INTEGER) AS max_depth, CAST(n_iter AS INTEGER) AS n_iter, kernel, 3 AS n_components FROM v_catalog""")
def scan_catalog(spark, folder):
    return read_catalog(spark, folder).select(
        "pipeline_id", "dataset.original.n_samples", "dataset.original.n_features", F.col("model.type").alias("model_type"),
        "model.params.max_depth", "model.params.n_iter", "model.params.kernel", F.size("components_type").alias("n_components"))


@query("sink_artifacts", SPLIT_SQL)
def sink_artifacts(spark, folder):
    path = scratch_path(spark, "artifacts")
    files.write_artifacts(prep.random_split(view(spark, folder, "v_tab"), "row_key"), path)
    return spark.read.parquet(path)
