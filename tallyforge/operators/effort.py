"""Effort model: operation counts of preprocessing, training and evaluation.

Each estimator is a pair of Column expressions over n (samples), d (features) and the
model's parameters; the whole catalog is one projection. Products are doubles, since a
bigint product of large catalogs overflows. A new model type is one more entry in
`ESTIMATORS`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.ordered import exact_rank

# Parameter defaults and the multiply-accumulate accounting.
DEFAULT_ITERATIONS = {"linear_regression": 1000, "logistic_regression": 100, "svm": 100}
DEFAULT_TREES = 100
PASSES_TRAIN = 3
FLOPS_PER_MAC = 2
# The phases a task can have.
PHASES = ("preprocessing", "training", "evaluation")


@dataclass(frozen=True)
class Inputs:
    """Columns an estimator reads. `param` gives a model parameter, NULL when absent."""

    n: Column
    d: Column
    param: Callable[[str], Column]

    def or_default(self, name: str, value) -> Column:
        return F.coalesce(self.param(name).cast("double"), F.lit(float(value)))


def _whole(value: Column) -> Column:
    """Drops the fraction but stays a double, so that it cannot overflow."""
    return value - value % 1.0


def linear_train(x: Inputs) -> Column:
    solver = F.coalesce(x.param("solver"), F.lit("ols"))
    steps = x.or_default("n_iter", DEFAULT_ITERATIONS["linear_regression"])
    unknown = F.raise_error(F.concat(F.lit("unknown solver for linear regression: "), solver)).cast("double")
    return (
        F.when(solver == "ols", x.n * x.d * x.d + x.d * x.d * x.d)
        .when(solver == "sgd", steps * x.n * x.d)
        .otherwise(unknown)
    )


def dense_pass(x: Inputs) -> Column:
    """One multiply per sample and feature."""
    return x.n * x.d


def logistic_train(x: Inputs) -> Column:
    return x.n * x.d * x.or_default("n_iter", DEFAULT_ITERATIONS["logistic_regression"])


def tree_train(x: Inputs) -> Column:
    return _whole(x.d * x.n * F.log2(x.n))


def tree_predict(x: Inputs) -> Column:
    """n * depth. Without a depth the cost is unknown: NULL. A depth of 0 falls back to log2 n."""
    by_depth = x.n * x.param("max_depth").cast("double")
    return _whole(F.when(by_depth == 0, F.log2(x.n)).otherwise(by_depth))


def forest_train(x: Inputs) -> Column:
    return x.or_default("n_estimators", DEFAULT_TREES) * x.d * x.n * F.floor(F.log2(x.n))


def forest_predict(x: Inputs) -> Column:
    depth = F.nullif(x.param("max_depth").cast("double"), F.lit(0.0))
    return x.n * x.or_default("n_estimators", DEFAULT_TREES) * F.coalesce(depth, F.log2(x.n))


def _is_linear(x: Inputs) -> Column:
    return F.coalesce(x.param("kernel"), F.lit("linear")) == "linear"


def svm_train(x: Inputs) -> Column:
    steps = x.or_default("n_iter", DEFAULT_ITERATIONS["svm"])
    return x.n * x.d * steps * F.when(_is_linear(x), 1.0).otherwise(x.n)


def svm_predict(x: Inputs) -> Column:
    vectors = F.coalesce(x.param("support_vectors").cast("double"), x.n)
    return x.n * x.d * F.when(_is_linear(x), 1.0).otherwise(vectors)


def network_train(x: Inputs) -> Column:
    return FLOPS_PER_MAC * PASSES_TRAIN * x.param("n_epochs").cast("double") * x.n * x.param("macs").cast("double")


def network_predict(x: Inputs) -> Column:
    return FLOPS_PER_MAC * x.n * x.param("macs").cast("double")


def pca_train(x: Inputs) -> Column:
    return x.n * x.d * x.d + x.d * x.d * x.d


def tsne_train(x: Inputs) -> Column:
    return x.n * x.n * x.d


def no_prediction(x: Inputs) -> Column:
    return F.lit(None).cast("double")


# model type -> (training, prediction)
ESTIMATORS: Mapping[str, tuple[Callable[[Inputs], Column], Callable[[Inputs], Column]]] = {
    "linear_regression": (linear_train, dense_pass),
    "logistic_regression": (logistic_train, dense_pass),
    "decision_tree": (tree_train, tree_predict),
    "random_forest": (forest_train, forest_predict),
    "svm": (svm_train, svm_predict),
    "nn": (network_train, network_predict),
    "cnn": (network_train, network_predict),
    "pca": (pca_train, no_prediction),
    "tsne": (tsne_train, no_prediction),
}


def model_effort(model: Column, x: Inputs, training: bool, estimators=ESTIMATORS) -> Column:
    """The estimator of the row's model type; an unknown model is an error."""
    effort = None
    for name, pair in estimators.items():
        value = pair[0 if training else 1](x)
        effort = F.when(model == name, value) if effort is None else effort.when(model == name, value)
    unknown = F.raise_error(F.concat(F.lit("unknown model type: "), F.coalesce(model, F.lit("null")))).cast("double")
    return effort.otherwise(unknown)


# --- layers ---------------------------------------------------------------------------

def layer_macs(layer: Column, convolution: bool) -> Column:
    """Multiply-accumulates of one layer struct; dense networks count Dense layers only."""
    def at(field: str, i: int) -> Column:
        return F.get(layer[field], F.lit(i)).cast("double")

    dense = at("input_shape", 0) * at("output_shape", 0) + at("output_shape", 0)
    macs = F.when(layer["type"] == "Dense", dense)
    if convolution:
        plane = at("input_shape", 2) * at("output_shape", 0) * at("output_shape", 1)
        kernel = at("kernel_size", 0) * at("kernel_size", 1)
        pool = at("pool_size", 0) * at("pool_size", 1)
        stride = at("strides", 0)
        macs = macs.when(layer["type"] == "Conv2D", kernel * plane * at("output_shape", 2) / (stride * stride))
        macs = macs.when(layer["type"] == "MaxPooling2D", pool * plane)
    return macs.otherwise(0.0)


def network_macs(layers: Column, convolution: bool) -> Column:
    """Sum over an array of layer structs, fraction dropped at the end."""
    total = F.aggregate(layers, F.lit(0.0), lambda acc, layer: acc + layer_macs(layer, convolution))
    return _whole(total)


def dense_macs_table(layers: DataFrame, key: str) -> DataFrame:
    """The same for layers kept as a long table: rows (key, macs)."""
    one = F.when(F.col("type") == "Dense", F.col("n_in") * F.col("n_out") + F.col("n_out")).otherwise(0)
    return layers.groupBy(key).agg(F.sum(one).cast("double").alias("macs"))


def layer_macs_table(layers: DataFrame, key: str, layer: str = "layer") -> DataFrame:
    """The same for any layer structs in a long table; sums map-side, so no layer list is collected."""
    macs = layers.groupBy(key).agg(F.sum(layer_macs(F.col(layer), True)).alias("macs"))
    return macs.withColumn("macs", _whole(F.col("macs")))


# --- catalog --------------------------------------------------------------------------

def product(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1.0), lambda acc, side: acc * side)


def preprocessing_effort(dataset: Column) -> Column:
    """Samples x features of the original data; an image has height x width x channels features."""
    original = dataset["original"]
    features = F.when(dataset["type"] == "image", product(original["input_shape"])).otherwise(original["n_features"])
    return original["n_samples"].cast("double") * features


def scaled_inputs(dataset: Column, share: Column) -> tuple[Column, Column]:
    """(n, d) of one phase on the prepared data.

    Samples are cut to the phase's share; so is the feature count of images, which the
    golden numbers depend on.
    """
    prepared = dataset["preprocessed"]
    n = _whole(prepared["n_samples"].cast("double") * share)
    image = _whole(product(prepared["input_shape"]) * share)
    return n, F.when(prepared["input_shape"].isNotNull(), image).otherwise(prepared["n_features"].cast("double"))


def catalog_task_efforts(catalog: DataFrame) -> DataFrame:
    """Nested catalog -> rows (pipeline_id, component, type, effort); an unknown task type counts 0."""
    dataset, model = F.col("dataset"), F.col("model")
    params = model["params"]

    def inputs(share: str) -> Inputs:
        n, d = scaled_inputs(dataset, dataset[share].cast("double"))
        macs = F.when(model["type"] == "cnn", network_macs(params["layers"], True)).otherwise(
            network_macs(params["layers"], False)
        )
        return Inputs(n, d, lambda name: macs if name == "macs" else params[name])

    by_type = (
        F.when(F.col("type") == "preprocessing", preprocessing_effort(dataset))
        .when(F.col("type") == "training", model_effort(model["type"], inputs("train_percentage"), True))
        .when(F.col("type") == "evaluation", model_effort(model["type"], inputs("test_percentage"), False))
        .otherwise(0.0)
    )
    tasks = catalog.select("pipeline_id", "dataset", "model", F.explode("components_type").alias("component", "type"))
    return tasks.select("pipeline_id", "component", "type", by_type.alias("effort"))


def flat_inputs(share: str, columns: Iterable[str]) -> Inputs:
    """Inputs over a flat catalog: n_samples, n_features, and every parameter that is one of its `columns`."""
    present = frozenset(columns)
    n = _whole(F.col("n_samples").cast("double") * F.col(share))
    return Inputs(n, F.col("n_features").cast("double"), lambda name: F.col(name) if name in present else F.lit(None))


def flat_phase_efforts(columns: Iterable[str]) -> dict[str, Column]:
    """Effort of each phase of a flat catalog row."""
    return {
        "preprocessing": F.col("n_samples").cast("double") * F.col("n_features"),
        "training": model_effort(F.col("model_type"), flat_inputs("train_percentage", columns), True),
        "evaluation": model_effort(F.col("model_type"), flat_inputs("test_percentage", columns), False),
    }


def _total(phases: Mapping[str, Column]) -> Column:
    """Sum over the phases; a phase of unknown effort counts 0."""
    return sum((F.coalesce(phases[p], F.lit(0.0)) for p in PHASES), F.lit(0.0))


def flat_task_efforts(catalog: DataFrame, total: bool = False) -> DataFrame:
    """Flat catalog -> one row per pipeline and phase, and one `total` row if wanted. No shuffle."""
    efforts = catalog.select("pipeline_id", *[e.alias(f"_{p}") for p, e in flat_phase_efforts(catalog.columns).items()])
    rows = {p: F.col(f"_{p}") for p in PHASES}
    if total:
        rows["total"] = _total(rows)
    structs = [F.struct(F.lit(p).alias("type"), e.alias("effort")) for p, e in rows.items()]
    return efforts.select("pipeline_id", F.inline(F.array(*structs)))


def flat_totals(catalog: DataFrame) -> DataFrame:
    """Flat catalog with the total effort of each row. No shuffle."""
    return catalog.withColumn("effort", _total(flat_phase_efforts(catalog.columns)))


def effort_totals(efforts: DataFrame) -> DataFrame:
    """Tasks followed by one `total` row per pipeline.

    Each pipeline's tasks are summed without a window, so one large pipeline cannot
    fill a task.
    """
    tasks = efforts.select("pipeline_id", "type", "effort")
    totals = efforts.groupBy("pipeline_id").agg(F.sum("effort").alias("effort"))
    return tasks.unionByName(totals.select("pipeline_id", F.lit("total").alias("type"), "effort"))


def effort_order(totals: DataFrame, window: str = "window", submitted: str = "submitted_at") -> DataFrame:
    """Position in its submission window: least total effort first, ties by submission, then id."""
    seq = totals.withColumn("_us", F.unix_micros(F.col(submitted).cast("timestamp")))
    return exact_rank(seq, [window], ["effort", "_us", "pipeline_id"], "position").drop("_us")
