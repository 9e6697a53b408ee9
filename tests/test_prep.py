import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyforge.operators import prep, recipes
from tallyforge.operators.smote import resampler
from tallyforge.sources import schemas


def test_sentinels_and_duplicates(spark):
    df = spark.createDataFrame([("?", "x", 1), (None, "y", 1), ("?", "x", 1)], "a string, b string, n int")
    assert {tuple(r) for r in prep.sentinel_columns(df).collect()} == {("a", True), ("b", False)}
    clean = prep.drop_duplicates(prep.sentinel_to_null(df))
    assert {tuple(r) for r in clean.collect()} == {(None, "x", 1), (None, "y", 1)}
    assert prep.sentinel_columns(df.select("n")).count() == 0


@pytest.mark.parametrize("margin,piece_rows", [(1e-4, 1_000_000), (0.2, 1_000_000), (0.2, 30)])
def test_quantiles_equal_numpy(spark, margin, piece_rows):
    draw = np.random.default_rng(5)
    a = np.concatenate([draw.normal(0, 1, 997), np.full(500, 2.5)])
    df = spark.createDataFrame([(float(x), i % 7, None) for i, x in enumerate(a)], "a double, b int, c double")
    got = prep.fit_quantiles(df, ["a", "b", "c"], [0.0, 0.1, 0.25, 0.5, 0.75, 1.0], margin, piece_rows)
    for column, values in (("a", a), ("b", np.arange(len(a)) % 7)):
        assert got[column] == pytest.approx(list(np.quantile(values, [0.0, 0.1, 0.25, 0.5, 0.75, 1.0])), abs=1e-12)
    assert got["c"] == [None] * 6


def test_clip_keeps_null_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (4.0, None), (1000.0, None), (None, None)], "a double, b double")
    got = [r["a"] for r in prep.iqr_clip(df).collect()]
    assert got == [1.0, 2.0, 3.0, 4.0, 7.0, None]
    assert prep.iqr_clip(df, sketch=True).count() == 6


def test_label_encode_orders_bytes_and_puts_missing_last(spark):
    df = spark.createDataFrame([("b",), (None,), ("B",), ("é",), ("b",)], "c string")
    got = [r["c"] for r in prep.label_encode(df, ["c"]).collect()]
    assert got == [1, 3, 0, 2, 1]
    shuffled = prep.label_encode(df, ["c"], max_broadcast=0)
    assert sorted(r["c"] for r in shuffled.collect()) == [0, 1, 1, 2, 3]


def test_mapping_matches_exactly(spark):
    df = spark.createDataFrame([("Bachelors",), ("Bachelors ",), (None,)], "e string")
    assert [r["e"] for r in prep.map_values(df, "e", recipes.EDUCATION).collect()] == [None, "graduate", None]
    assert [r["e"] for r in prep.collapse_to_other(df, "e", "Bachelors").collect()] == ["Bachelors", "Other", "Other"]
    table = spark.createDataFrame([("Bachelors", "x")], "key string, value string")
    for bound in (0, 10):
        got = prep.map_values_table(df, "e", table, "m", bound).collect()
        assert {(r["e"], r["m"]) for r in got} == {("Bachelors", "x"), ("Bachelors ", None), (None, None)}


def test_dotted_names_survive(spark):
    df = spark.createDataFrame([("1", 2, 0.5)], "`ID` string, `default.payment.next.month` int, `PAY.0` double")
    out = recipes.clean_credit(df)
    assert out.columns == ["default", "PAY.0"]
    assert recipes.credit(df).count() == 1


def test_scaling_uses_population_spread_and_leaves_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in prep.standard_scale(df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_splits_are_disjoint_complete_and_exact(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("label"))
    split = prep.stratified_split(df, "k", "label")
    sizes = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    for label in range(3):
        n = len([i for i in range(1003) if i % 3 == label])
        assert sizes[label, "test"] == math.ceil(0.2 * n)
        assert sizes[label, "train"] == n - sizes[label, "test"]
    one = {tuple(r) for r in prep.random_split(df.coalesce(1), "k").collect()}
    many = {tuple(r) for r in prep.random_split(df.repartition(9), "k").collect()}
    assert one == many and len(one) == 1003


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_stratified_split_of_copies_is_exact(spark, hot_rows):
    # One key holds two thirds of its class, the classes NULL and 2 are tiny.
    rows = [("same", 1)] * 400 + [(f"k{i}", 1) for i in range(200)] + [("x", None), ("y", None), ("z", 2)]
    df = spark.createDataFrame(rows, "k string, label int").repartition(6)
    split = prep.stratified_split(df, "k", "label", hot_rows=hot_rows)
    sizes = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert sizes == {(1, "test"): 120, (1, "train"): 480, (None, "test"): 1, (None, "train"): 1, (2, "test"): 1}


def test_reshape_round_trip_and_wrong_size(spark):
    df = spark.createDataFrame([([float(i) for i in range(12)],)], "x array<double>")
    nested = df.select(prep.reshape_array(F.col("x"), [2, 3, 2]).alias("y")).first()["y"]
    assert nested == np.arange(12.0).reshape(2, 3, 2).tolist()
    flat = df.select(prep.flatten_array(prep.reshape_array(F.col("x"), [2, 3, 2]), 3).alias("z")).first()["z"]
    assert flat == [float(i) for i in range(12)]
    with pytest.raises(PySparkException, match="expected 10 values"):
        df.select(prep.reshape_array(F.col("x"), [2, 5])).collect()


CENSUS = ("age bigint, workclass string, fnlwgt bigint, education string, `marital-status` string, occupation string, relationship string, "
          "race string, gender string, `capital-gain` bigint, `capital-loss` bigint, `hours-per-week` bigint, `native-country` string, income string")


def test_census_recipe(spark):
    rows = []
    for i in range(300):
        rows.append((20 + i % 50, ["Private", "?", "State-gov"][i % 3], 1000 + 7 * i, ["HS-grad", "Masters", "Bachelors"][i % 3],
                     "Divorced", "Sales", "Husband", ["White", "Black"][i % 2], ["Male", "Female"][i % 2], 0, 0, 40 + i % 5,
                     "United-States", ">50K" if i % 5 == 0 else "<=50K"))
    df = spark.createDataFrame(rows + rows[:20], CENSUS)
    clean = recipes.clean_census(df)
    assert clean.count() == 300
    assert "capital-gain" not in clean.columns
    assert {r["workclass"] for r in clean.select("workclass").distinct().collect()} == {0, 1, 2}
    out = recipes.census(df, resample=resampler())
    counts = {r["income"]: r["count"] for r in out.groupBy("income").count().collect()}
    assert counts == {0: 240, 1: 240}
    assert {r["split"] for r in out.select("split").distinct().collect()} == {"train", "test"}


def test_other_recipes(spark):
    wine = spark.createDataFrame([(7.0 + i, i % 9) for i in range(50)], "acidity double, quality bigint")
    assert {r["quality"] for r in recipes.wine(wine).collect()} == {0, 1}
    flows = spark.createDataFrame([(i, float(i), ["tcp", "udp"][i % 2], "x", i % 2) for i in range(60)] + [(99, None, "tcp", "x", 0)],
                                  "id bigint, dur double, proto string, attack_cat string, label bigint")
    out = recipes.flows(flows)
    assert out.count() == 60 and {r["proto"] for r in out.select("proto").distinct().collect()} == {0, 1}
    blank = [0 if f.dataType.typeName() == "long" else 0.0 for f in schemas.CONNECTION_LOG.fields]
    log = []
    for i in range(20):
        row = list(blank)
        row[0], row[1], row[2], row[3], row[41] = i, "tcp", "http", "SF", "normal." if i % 2 else "smurf."
        log.append(tuple(row))
    done = recipes.connections(spark.createDataFrame(log, schemas.CONNECTION_LOG))
    assert {r["label"] for r in done.select("label").distinct().collect()} == {0, 1}
    assert len(schemas.CONNECTION_LOG_NAMES) == 42


def test_scaling_is_a_short_projection_of_constants(spark):
    """Long projections are not compiled: no subquery and no map look-up per value."""
    df = spark.createDataFrame([(float(i), i * 2, 7, i % 5 > 0) for i in range(10)], "a double, b int, flat int, part boolean")
    scaled = prep.standard_scale(df, ["a", "b", "flat"], F.col("part"))
    plan = scaled._jdf.queryExecution().optimizedPlan().toString()
    assert "subquery" not in plan.lower() and "_stats" not in plan
    train = [i for i in range(10) if i % 5]
    mean, std = np.mean(train), np.std(train)
    for i, r in enumerate(scaled.orderBy("a").collect()):
        assert abs(r["a"] - (i - mean) / std) < 1e-12 and abs(r["b"] - r["a"]) < 1e-12 and r["flat"] == 0.0
    assert prep.standard_scale(df, []).columns == df.columns
    assert {r["a"] for r in prep.standard_scale(df, ["a"], F.col("a") < 0).collect()} == {None}
