"""Quantiles from sketches of parts, after appends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import prep, sketches


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(2)
    made = [(i % 9, float(a), int(b), None) for i, (a, b) in enumerate(zip(draw.lognormal(size=20_000), draw.integers(0, 5, 20_000)))]
    made += [(9, None, None, None)] * 5
    return spark.createDataFrame(made, "day int, `a.x` double, b int, c double").persist()


def test_appends_sketch_new_parts_only_and_stay_near(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    columns = ["a.x", "b", "c"]
    for upto in (3, 3, 7, 10):
        before = {(r.part, r.column): bytes(r.sketch) for r in sketches.stored_sketches(spark, path).collect()}
        sketches.refresh_sketches(rows.filter(F.col("day") < upto), path, F.col("day"), columns)
        after = {(r.part, r.column): bytes(r.sketch) for r in sketches.stored_sketches(spark, path).collect()}
        assert len(after) == 3 * upto and all(after[k] == v for k, v in before.items())
        table = sketches.stored_sketches(spark, path)
        assert table.count() == len(after)
        held = rows.filter(F.col("day") < upto).toPandas()
        for r in sketches.sketched_quantiles(table, (0.1, 0.25, 0.5, 0.99)).collect():
            values = np.sort(held[r.column].dropna().to_numpy())
            low, high = np.searchsorted(values, r.value, "left") / len(values), np.searchsorted(values, r.value, "right") / len(values)
            assert r.n == len(values) and low - 2 * sketches.rank_error() <= r.prob <= high + 2 * sketches.rank_error()
    found = {r.column for r in sketches.sketched_quantiles(sketches.stored_sketches(spark, path)).collect()}
    assert found == {"a.x", "b"}


def test_limits_clip(spark, rows, tmp_path):
    table = sketches.refresh_sketches(rows, str(tmp_path / "s"), F.col("day"), ["a.x", "b", "c"])
    limits = sketches.sketched_limits(table)
    exact = prep.iqr_limits(rows, ["a.x"])
    assert set(limits) == {"a.x", "b"} and limits["a.x"] == pytest.approx(exact["a.x"], rel=0.02)
    clipped = prep.clip_to(rows, limits)
    top = clipped.agg(F.max("`a.x`")).first()[0]
    assert top == limits["a.x"][1] and clipped.filter("`a.x` IS NULL").count() == 5
