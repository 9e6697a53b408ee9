import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyforge.operators import datasets, effort, lineage
from tallyforge.sources import files
from tests.golden import GOLDEN, catalog_objects


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    """One metadata file per pipeline, as a user would keep them."""
    root = tmp_path_factory.mktemp("catalog")
    for row in catalog_objects():
        (root / row["pipeline_id"]).mkdir()
        (root / row["pipeline_id"] / "metadata.json").write_text(json.dumps(row, indent=4))
    return files.read_catalog(spark, str(root))


def test_golden_efforts(catalog):
    efforts = effort.effort_totals(effort.catalog_task_efforts(catalog))
    got = {(r["pipeline_id"], r["type"]): r["effort"] for r in efforts.collect()}
    assert len(got) == 4 * len(GOLDEN)
    for name, _, _, _, numbers, _ in GOLDEN:
        for kind, want in zip(("preprocessing", "training", "evaluation", "total"), numbers):
            assert got[name, kind] == pytest.approx(want, abs=0.01), (name, kind)


def test_golden_order_keeps_submission_order_on_ties(catalog):
    totals = effort.effort_totals(effort.catalog_task_efforts(catalog)).filter("type = 'total'").drop("type")
    timed = totals.join(catalog.select("pipeline_id", "submitted_at"), "pipeline_id").withColumn("window", F.lit(1))
    got = [r["pipeline_id"] for r in effort.effort_order(timed).orderBy("position").collect()]
    assert got == [g[0] for g in GOLDEN]


def test_golden_sizes(catalog):
    sizes = catalog.filter("dataset.original.data_types IS NOT NULL").select(
        "pipeline_id",
        *[datasets.array_size_kb(F.col(f"dataset.{v}.n_samples"), F.col(f"dataset.{v}.data_types")).alias(v) for v in ("original", "preprocessed")])
    got = {r["pipeline_id"]: (r["original"], r["preprocessed"]) for r in sizes.collect()}
    assert got == {g[0]: g[5] for g in GOLDEN if g[5]}


def flat(spark, **columns):
    row = {"n_samples": 100, "n_features": 3, "train_percentage": 1.0, "test_percentage": 1.0, "n_iter": None, "max_depth": None,
           "kernel": None, "model_type": "svm", "pipeline_id": 1, **columns}
    schema = ("n_samples bigint, n_features bigint, train_percentage double, test_percentage double, n_iter int, max_depth int, "
              "kernel string, model_type string, pipeline_id bigint")
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)


def test_defaults_and_missing_depth(spark):
    def phases(df):
        return {r["type"]: r["effort"] for r in effort.flat_task_efforts(df).collect()}

    assert phases(flat(spark))["training"] == 100 * 3 * 100
    assert phases(flat(spark, model_type="decision_tree"))["evaluation"] is None
    assert phases(flat(spark, model_type="random_forest", n_samples=1024))["evaluation"] == 1024 * 100 * 10
    assert phases(flat(spark, model_type="pca"))["evaluation"] is None
    assert phases(flat(spark, kernel="rbf"))["evaluation"] == 100 * 100 * 3
    huge = phases(flat(spark, kernel="rbf", n_samples=10**12))
    assert huge["training"] == pytest.approx(1e24 * 300)


def test_unknown_names_are_errors(spark):
    with pytest.raises(PySparkException, match="unknown model type: oracle"):
        effort.flat_task_efforts(flat(spark, model_type="oracle")).collect()
    inputs = effort.Inputs(F.lit(1.0), F.lit(1.0), lambda name: F.lit("newton") if name == "solver" else F.lit(None))
    with pytest.raises(PySparkException, match="newton"):
        spark.range(1).select(effort.linear_train(inputs)).collect()
    types = F.create_map(F.lit("int63"), F.lit(1))
    with pytest.raises(PySparkException, match="int63"):
        spark.range(1).select(datasets.array_size_kb(F.lit(1), types)).collect()


def test_unknown_task_type_counts_nothing(catalog):
    odd = catalog.withColumn("components_type", F.create_map(F.lit("x"), F.lit("deployment")))
    assert {r["effort"] for r in effort.catalog_task_efforts(odd).collect()} == {0.0}


def test_image_sizes_come_from_the_registry(spark):
    rows = [("a", "image", False), ("b", "image", True), ("c", "image", False)]
    data = spark.createDataFrame(rows, "name string, type string, normalized boolean").withColumns(
        {"n_samples": F.lit(10), "data_types": F.lit(None).cast("map<string,int>")})
    registry = spark.createDataFrame([("a", 10), ("b", 10)], "name string, size_kb bigint")
    assert {r["name"]: r["size_kb"] for r in datasets.size_in_memory(data, registry).collect()} == {"a": 80, "b": 10, "c": None}


def test_edges_prefer_the_last_producer(spark):
    args = spark.createDataFrame([
        ("p", 1, "prep", "x", "OutputDataset"), ("p", 2, "again", "x", "OutputDataset"), ("p", 3, "train", "x", "InputDataset"),
        ("p", 3, "train", "m", "OutputModel"), ("p", 4, "eval", "m", "InputModel"), ("p", 4, "eval", "x", "InputDataset"),
        ("p", 4, "eval", "n", "int"), ("q", 1, "train", "x", "InputDataset"),
    ], "pipeline_id string, position int, component string, arg string, kind string")
    got = {tuple(r) for r in lineage.artifact_edges(args).collect()}
    assert got == {("p", "x", "again", "train"), ("p", "x", "again", "eval"), ("p", "m", "train", "eval")}
    names = spark.createDataFrame([("Data_Preprocessing.v2.py",), ("plain",)], "f string")
    assert [r[0] for r in names.select(lineage.normalize_component(F.col("f"))).collect()] == ["data-preprocessing", "plain"]
