import pytest

from tallyforge.operators import metrics as ops


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "label int, prediction int")


def test_binary_scores(spark):
    df = frame(spark, [(1, 1)] * 3 + [(0, 1)] * 2 + [(1, 0)] + [(0, 0)] * 4)
    assert ops.accuracy(df).first()[0] == 0.7
    assert ops.precision_binary(df).first()[0] == 0.6
    assert ops.f1_binary(df).first()[0] == pytest.approx(6 / 9)


def test_undefined_scores_are_zero(spark):
    df = frame(spark, [(0, 0), (0, 0)])
    assert (ops.accuracy(df).first()[0], ops.precision_binary(df).first()[0], ops.f1_binary(df).first()[0]) == (1.0, 0.0, 0.0)
    assert ops.accuracy(frame(spark, [])).first()[0] == 0.0


def test_weighted_scores_count_absent_classes(spark):
    # Class 2 is never predicted, class 3 never true.
    df = frame(spark, [(0, 0), (0, 1), (1, 1), (2, 1), (1, 3)])
    precision = (2 * 1.0 + 2 * (1 / 3) + 1 * 0.0) / 5
    f1 = (2 * (2 / 3) + 2 * (2 / 5) + 0.0) / 5
    assert ops.precision_weighted(df).first()[0] == pytest.approx(precision)
    assert ops.f1_weighted(df).first()[0] == pytest.approx(f1)
    cells = {(r["label"], r["prediction"]): r["n"] for r in ops.confusion_matrix(df).collect()}
    assert len(cells) == 16 and sum(cells.values()) == 5 and cells[2, 2] == 0 and cells[1, 3] == 1


def test_report_matches_its_parts(spark):
    df = frame(spark, [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)])
    rows = ops.evaluation_report(df, weighted=True).collect()
    assert {r["precision"] for r in rows} == {ops.precision_weighted(df).first()[0]}
    assert {r["f1_score"] for r in rows} == {ops.f1_weighted(df).first()[0]} and {r["accuracy"] for r in rows} == {0.6}
    cells = {(r["label"], r["prediction"]): r["n"] for r in rows}
    assert cells == {(a, b): {(0, 0): 1, (0, 1): 1, (1, 1): 2, (2, 1): 1}.get((a, b), 0) for a in range(3) for b in range(3)}
    keyed = ops.evaluation_report(df.withColumn("model", df.label % 2), ["model"], weighted=True).collect()
    assert {(r["model"], r["label"], r["prediction"]): r["n"] for r in keyed} == {
        (0, 0, 0): 1, (0, 0, 1): 1, (0, 0, 2): 0, (0, 1, 0): 0, (0, 1, 1): 0, (0, 1, 2): 0, (0, 2, 0): 0, (0, 2, 1): 1, (0, 2, 2): 0, (1, 1, 1): 2}


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9],)], "p array<double>")
    assert df.select(ops.argmax(df.p)).first()[0] == 1
