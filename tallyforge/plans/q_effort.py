"""Queries over the effort model and artifact lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import effort as ops
from tallyforge.operators import lineage
from tallyforge.plans.registry import query
from tallyforge.plans.views import view
from tallyforge.sources.tables import table

N = "CAST(n_samples AS DOUBLE)"
D = "CAST(n_features AS DOUBLE)"
N_TRAIN = f"trunc({N} * train_percentage)"
N_TEST = f"trunc({N} * test_percentage)"


def catalog(spark, folder):
    return view(spark, folder, "v_catalog")


def _phase_query(train, predict):
    """train and evaluation effort of every pipeline under one estimator."""
    def run(spark, folder):
        return catalog(spark, folder).select(
            "pipeline_id",
            train(ops.flat_inputs("train_percentage", catalog(spark, folder).columns)).cast("double").alias("train_effort"),
            predict(ops.flat_inputs("test_percentage", catalog(spark, folder).columns)).cast("double").alias("eval_effort"),
        )
    return run


def _phase_sql(train: str, predict: str) -> str:
    return f"""SELECT pipeline_id, CAST({train} AS DOUBLE) AS train_effort, CAST({predict} AS DOUBLE) AS eval_effort
    FROM v_catalog"""


@query("effort_preprocessing", f"SELECT pipeline_id, {N} * {D} AS effort FROM v_catalog")
def effort_preprocessing(spark, folder):
    """Flat tabular rows in the nested layout the operator reads."""
    shape = F.lit(None).cast("array<int>").alias("input_shape")
    dataset = F.struct(F.lit("tabular").alias("type"), F.struct("n_samples", "n_features", shape).alias("original"))
    return catalog(spark, folder).select("pipeline_id", ops.preprocessing_effort(dataset).cast("double").alias("effort"))


@query("effort_params", f"""SELECT pipeline_id, {N_TRAIN} AS n_train, {N_TEST} AS n_test,
    CASE WHEN pipeline_id % 2 = 0 THEN {D} ELSE trunc(({D} * {D} * 3) * train_percentage) END AS d_train FROM v_catalog""")
def effort_params(spark, folder):
    """Odd pipelines are read as d x d x 3 images, whose features shrink with the share."""
    side = F.col("n_features").cast("int")
    shape = F.when(F.col("pipeline_id") % 2 == 1, F.array(side, side, F.lit(3))).alias("input_shape")
    dataset = F.struct(F.struct("n_samples", "n_features", shape).alias("preprocessed"))
    n_train, d_train = ops.scaled_inputs(dataset, F.col("train_percentage"))
    n_test, _ = ops.scaled_inputs(dataset, F.col("test_percentage"))
    return catalog(spark, folder).select("pipeline_id", n_train.alias("n_train"), n_test.alias("n_test"),
                                         d_train.alias("d_train"))


@query("effort_linear", _phase_sql(
    f"CASE WHEN pipeline_id % 2 = 0 THEN {N_TRAIN} * {D} * {D} + {D} * {D} * {D} ELSE coalesce(n_iter, 1000) * {N_TRAIN} * {D} END",
    f"{N_TEST} * {D}"))
def effort_linear(spark, folder):
    """Even pipelines use ordinary least squares (the default), odd ones gradient descent."""
    solver = F.when(F.col("pipeline_id") % 2 == 1, "sgd")
    columns = catalog(spark, folder).columns
    train, test = ops.flat_inputs("train_percentage", columns), ops.flat_inputs("test_percentage", columns)
    with_solver = ops.Inputs(train.n, train.d, lambda name: solver if name == "solver" else train.param(name))
    return catalog(spark, folder).select("pipeline_id", ops.linear_train(with_solver).alias("train_effort"),
                                         ops.dense_pass(test).alias("eval_effort"))


query("effort_logistic", _phase_sql(f"{N_TRAIN} * {D} * coalesce(n_iter, 100)", f"{N_TEST} * {D}"))(
    _phase_query(ops.logistic_train, ops.dense_pass))

query("effort_tree", _phase_sql(f"trunc({D} * {N_TRAIN} * log2({N_TRAIN}))", f"trunc({N_TEST} * max_depth)"))(
    _phase_query(ops.tree_train, ops.tree_predict))

FOREST_TRAIN = f"coalesce(n_estimators, 100) * {D} * {N_TRAIN} * floor(log2({N_TRAIN}))"
FOREST_EVAL = f"{N_TEST} * coalesce(n_estimators, 100) * coalesce(max_depth, log2({N_TEST}))"
SVM_TRAIN = f"{N_TRAIN} * {D} * coalesce(n_iter, 100) * CASE WHEN kernel = 'linear' THEN 1 ELSE {N_TRAIN} END"
SVM_EVAL = f"{N_TEST} * {D} * CASE WHEN kernel = 'linear' THEN 1 ELSE coalesce(support_vectors, {N_TEST}) END"

# Logarithms differ in their last bits between engines, so the fraction is shown to two decimals.
query("effort_forest", _phase_sql(FOREST_TRAIN, f"round({FOREST_EVAL}, 2)"))(
    _phase_query(ops.forest_train, lambda x: F.round(ops.forest_predict(x), 2)))

query("effort_svm", _phase_sql(SVM_TRAIN, SVM_EVAL))(_phase_query(ops.svm_train, ops.svm_predict))

query("effort_pca", _phase_sql(f"{N_TRAIN} * {D} * {D} + {D} * {D} * {D}", "NULL"))(
    _phase_query(ops.pca_train, ops.no_prediction))

query("effort_tsne", _phase_sql(f"{N_TRAIN} * {N_TRAIN} * {D}", "NULL"))(
    _phase_query(ops.tsne_train, ops.no_prediction))


def _network(spark, folder, macs):
    """Efforts for 10 epochs; a pipeline without layers has no multiply-accumulates."""
    joined = catalog(spark, folder).drop("macs", "n_epochs").join(macs, "pipeline_id", "left").withColumns(
        {"n_epochs": F.lit(10), "macs": F.coalesce("macs", F.lit(0.0))})

    def inputs(share):
        flat = ops.flat_inputs(share, ())
        return ops.Inputs(flat.n, flat.d, lambda name: F.col(name))

    return joined.select(
        "pipeline_id", "macs",
        ops.network_train(inputs("train_percentage")).alias("train_effort"),
        ops.network_predict(inputs("test_percentage")).alias("eval_effort"),
    )


def _network_sql(macs: str) -> str:
    return f"""WITH m AS ({macs}) SELECT pipeline_id, coalesce(m.macs, 0.0::DOUBLE) AS macs,
    60.0::DOUBLE * {N_TRAIN} * coalesce(m.macs, 0) AS train_effort,
    2.0::DOUBLE * {N_TEST} * coalesce(m.macs, 0) AS eval_effort FROM v_catalog LEFT JOIN m USING (pipeline_id)"""


@query("effort_dense", _network_sql("""SELECT pipeline_id, CAST(sum(n_in * n_out + n_out) AS DOUBLE) AS macs
    FROM v_layers GROUP BY pipeline_id"""))
def effort_dense(spark, folder):
    return _network(spark, folder, ops.dense_macs_table(view(spark, folder, "v_layers"), "pipeline_id"))


@query("effort_conv", _network_sql("""SELECT pipeline_id, trunc(sum(CASE layer % 4
        WHEN 1 THEN 3.0 * 3 * 3 * n_out * n_out * 8 / ((1 + n_in % 2) * (1 + n_in % 2))::DOUBLE
        WHEN 2 THEN 2.0 * 2 * 3 * n_out * n_out
        WHEN 3 THEN CAST(n_in * n_out + n_out AS DOUBLE) ELSE 0 END)) AS macs FROM v_layers GROUP BY pipeline_id"""))
def effort_conv(spark, folder):
    """Layer numbers 1..4 in turn are Conv2D, MaxPooling2D, Dense and Dropout."""
    kind = F.col("layer") % 4
    name = F.when(kind == 1, "Conv2D").when(kind == 2, "MaxPooling2D").when(kind == 3, "Dense").otherwise("Dropout")
    flat = kind == 3
    stride = 1 + F.col("n_in") % 2
    layer = F.struct(
        name.alias("type"),
        F.when(flat, F.array("n_in")).otherwise(F.array("n_in", "n_in", F.lit(3))).alias("input_shape"),
        F.when(flat, F.array("n_out")).otherwise(F.array("n_out", "n_out", F.lit(8))).alias("output_shape"),
        F.when(kind == 1, F.array(F.lit(3), F.lit(3))).alias("kernel_size"),
        F.when(kind == 1, F.array(stride, stride)).alias("strides"),
        F.when(kind == 2, F.array(F.lit(2), F.lit(2))).alias("pool_size"),
    )
    layers = view(spark, folder, "v_layers").select("pipeline_id", layer.alias("layer"))
    return _network(spark, folder, ops.layer_macs_table(layers, "pipeline_id"))


TRAIN_SQL = f"""CASE model_type
    WHEN 'linear_regression' THEN CASE WHEN solver = 'sgd' THEN coalesce(n_iter, 1000) * {N_TRAIN} * {D}
        ELSE {N_TRAIN} * {D} * {D} + {D} * {D} * {D} END
    WHEN 'logistic_regression' THEN {N_TRAIN} * {D} * coalesce(n_iter, 100)
    WHEN 'decision_tree' THEN trunc({D} * {N_TRAIN} * log2({N_TRAIN}))
    WHEN 'random_forest' THEN {FOREST_TRAIN} WHEN 'svm' THEN {SVM_TRAIN}
    WHEN 'nn' THEN 60.0::DOUBLE * {N_TRAIN} * macs END"""
EVAL_SQL = f"""CASE model_type
    WHEN 'decision_tree' THEN trunc({N_TEST} * max_depth)
    WHEN 'random_forest' THEN {FOREST_EVAL} WHEN 'svm' THEN {SVM_EVAL}
    WHEN 'nn' THEN 2.0::DOUBLE * {N_TEST} * macs
    ELSE {N_TEST} * {D} END"""
SUM_SQL = f"coalesce({N} * {D}, 0) + coalesce({TRAIN_SQL}, 0) + coalesce({EVAL_SQL}, 0)"
EFFORTS_SQL = f"""SELECT pipeline_id, 'preprocessing' AS type, {N} * {D} AS effort FROM v_catalog
    UNION ALL SELECT pipeline_id, 'training', {TRAIN_SQL} FROM v_catalog
    UNION ALL SELECT pipeline_id, 'evaluation', {EVAL_SQL} FROM v_catalog"""
TOTALS_SQL = f"SELECT pipeline_id, {SUM_SQL} AS effort FROM v_catalog"


@query("effort_dispatch", EFFORTS_SQL)
def effort_dispatch(spark, folder):
    return ops.flat_task_efforts(catalog(spark, folder))


# Layers of the nested catalog: each pipeline's network is a dense one, or a convolution with pooling before it.
NESTED_SQL = f"""WITH c AS (SELECT *, CASE WHEN pipeline_id % 2 = 0 THEN 'nn' ELSE 'cnn' END AS net,
        CAST(1 + n_features % 5 AS DOUBLE) AS w FROM v_catalog),
    m AS (SELECT *, CASE net WHEN 'nn' THEN {D} * 8 + 8 ELSE trunc(3 * 3 * 3 * w * w * 4 / 4 + 2 * 2 * 4 * w * w + ({D} * 8 + 8)) END AS net_macs FROM c)
    SELECT pipeline_id, 'preprocessing' AS type, {N} * (w * w * 3) AS effort FROM m
    UNION ALL SELECT pipeline_id, 'training', 60.0::DOUBLE * {N_TRAIN} * net_macs FROM m
    UNION ALL SELECT pipeline_id, 'evaluation', 2.0::DOUBLE * {N_TEST} * net_macs FROM m"""


@query("effort_dispatch_nested", NESTED_SQL)
def effort_dispatch_nested(spark, folder):
    """Image pipelines of the nested catalog, with lists of layers."""
    c = catalog(spark, folder)
    side, small = (F.lit(1) + F.col("n_features") % 5).cast("int"), F.lit(None).cast("array<int>")

    def layer(kind, inputs, outputs, kernel=small, strides=small, pool=small):
        return F.struct(F.lit(kind).alias("type"), F.array(*inputs).cast("array<int>").alias("input_shape"), F.array(*outputs).cast("array<int>").alias("output_shape"),
                        kernel.alias("kernel_size"), strides.alias("strides"), pool.alias("pool_size"))

    two, three = F.array(F.lit(2), F.lit(2)), F.array(F.lit(3), F.lit(3))
    dense = layer("Dense", [F.col("n_features")], [F.lit(8)])
    network = F.when(F.col("pipeline_id") % 2 == 0, F.array(dense, layer("Dropout", [F.lit(8)], [F.lit(8)]))).otherwise(F.array(
        layer("Conv2D", [side, side, F.lit(3)], [side, side, F.lit(4)], three, two),
        layer("MaxPooling2D", [side, side, F.lit(4)], [side, side, F.lit(4)], small, small, two), dense))
    version = F.struct("n_samples", "n_features", F.array(side, side, F.lit(3)).alias("input_shape"))
    params = F.struct(network.alias("layers"), F.lit(10).alias("n_epochs"), *[F.lit(None).cast(t).alias(n) for n, t in (
        ("max_depth", "int"), ("n_estimators", "int"), ("n_iter", "int"), ("kernel", "string"), ("solver", "string"), ("support_vectors", "bigint"))])
    model = F.struct(F.when(F.col("pipeline_id") % 2 == 0, "nn").otherwise("cnn").alias("type"), params.alias("params"))
    dataset = F.struct(F.lit("image").alias("type"), "train_percentage", "test_percentage", version.alias("original"), version.alias("preprocessed"))
    types = F.create_map(*[F.lit(x) for pair in zip(("a", "b", "c"), ops.PHASES) for x in pair])
    nested = c.select("pipeline_id", types.alias("components_type"), dataset.alias("dataset"), model.alias("model"))
    return ops.catalog_task_efforts(nested).drop("component")


@query("effort_totals", f"{EFFORTS_SQL} UNION ALL SELECT pipeline_id, 'total', effort FROM ({TOTALS_SQL}) AS t")
def effort_totals(spark, folder):
    return ops.flat_task_efforts(catalog(spark, folder), total=True)


@query("effort_totals_by_task", f"{EFFORTS_SQL} UNION ALL SELECT pipeline_id, 'total', effort FROM ({TOTALS_SQL}) AS t")
def effort_totals_by_task(spark, folder):
    """The same from a table of task efforts, whose tasks of one pipeline lie in many rows."""
    return ops.effort_totals(ops.flat_task_efforts(catalog(spark, folder)))


@query("effort_order", f"""WITH t AS (SELECT pipeline_id, date_trunc('month', submitted_at) AS w, submitted_at,
        {SUM_SQL} AS effort FROM v_catalog)
    SELECT pipeline_id, strftime(w, '%Y-%m') AS submission_window, effort,
        row_number() OVER (PARTITION BY w ORDER BY effort, submitted_at, pipeline_id) AS position FROM t""")
def effort_order(spark, folder):
    """Submission windows of one month."""
    totals = ops.flat_totals(catalog(spark, folder)).select(
        "pipeline_id", "submitted_at", F.date_format("submitted_at", "yyyy-MM").alias("submission_window"), "effort")
    return ops.effort_order(totals, "submission_window").drop("submitted_at")


# --- lineage --------------------------------------------------------------------------

ARGS_SQL = """SELECT l_orderkey AS pipeline_id, l_linenumber AS position, concat('c', l_linenumber) AS component,
    concat('a', l_partkey % 3) AS arg,
    CASE l_suppkey % 5 WHEN 0 THEN 'OutputDataset' WHEN 1 THEN 'InputDataset' WHEN 2 THEN 'OutputModel'
        WHEN 3 THEN 'InputModel' ELSE 'str' END AS kind FROM lineitem"""


def artifact_args(spark, folder):
    kinds = ["OutputDataset", "InputDataset", "OutputModel", "InputModel", "str"]
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("pipeline_id"), F.col("l_linenumber").alias("position"),
        F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("component"),
        F.concat(F.lit("a"), (F.col("l_partkey") % 3).cast("string")).alias("arg"),
        F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("l_suppkey") % 5).cast("int")).alias("kind"),
    )


@query("artifact_edges", f"""WITH args AS ({ARGS_SQL}),
    p AS (SELECT pipeline_id, arg, arg_max(component, position) AS producer FROM args WHERE contains(kind, 'Output')
          GROUP BY pipeline_id, arg)
    SELECT c.pipeline_id, c.arg AS artifact, p.producer, c.component AS consumer
    FROM args AS c JOIN p USING (pipeline_id, arg) WHERE starts_with(c.kind, 'Input')""")
def artifact_edges(spark, folder):
    return lineage.artifact_edges(artifact_args(spark, folder))


@query("artifact_arg_filter", f"""SELECT *, CASE WHEN contains(kind, 'Output') THEN 'producer' ELSE 'consumer' END AS role
    FROM ({ARGS_SQL}) AS a WHERE kind <> 'str'""")
def artifact_arg_filter(spark, folder):
    return lineage.artifact_arg_filter(artifact_args(spark, folder))


@query("normalize_component", """SELECT p_partkey, concat(upper(replace(p_name, ' ', '_')), '.v', p_size, '.py') AS filename,
    replace(lower(split_part(concat(upper(replace(p_name, ' ', '_')), '.v', p_size, '.py'), '.', 1)), '_', '-') AS component
    FROM part""")
def normalize_component(spark, folder):
    name = F.concat(F.upper(F.translate("p_name", " ", "_")), F.lit(".v"), F.col("p_size").cast("string"), F.lit(".py"))
    files = table(spark, folder, "part").select("p_partkey", name.alias("filename"))
    return files.withColumn("component", lineage.normalize_component(F.col("filename")))


@query("task_types", """SELECT l_orderkey AS pipeline_id, concat('c', l_linenumber) AS component,
    CASE WHEN o_orderkey IS NULL THEN NULL
         ELSE CASE l_linenumber WHEN 1 THEN 'preprocessing' WHEN 2 THEN 'training' WHEN 3 THEN 'evaluation' END END AS type
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def task_types(spark, folder):
    names = F.create_map(*[F.lit(x) for pair in zip(("c1", "c2", "c3"), ops.PHASES) for x in pair])
    components = table(spark, folder, "orders").select(F.col("o_orderkey").alias("pipeline_id"), names.alias("components_type"))
    tasks = artifact_args(spark, folder).select("pipeline_id", "component")
    return lineage.task_types(components, tasks)
