"""Evaluation metrics. All derive from one count per (label, prediction).

`keys` groups the rows by model, run or dataset. The counts combine map-side, so their
shuffle carries at most one row per task, key and class pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.numbers import ratio_or_zero


def pair_counts(predictions: DataFrame, keys: Sequence[str] = (), label: str = "label",
                prediction: str = "prediction") -> DataFrame:
    """Rows (keys.., label, prediction, n)."""
    return predictions.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _n_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


CORRECT = "label = prediction"


def _accuracy() -> Column:
    return ratio_or_zero(_n_where(F.expr(CORRECT)), F.sum("n"))


def _binary(positive) -> tuple[Column, Column, Column]:
    is_true, said = F.col("label") == positive, F.col("prediction") == positive
    return _n_where(is_true & said), _n_where(~is_true & said), _n_where(is_true & ~said)


def _precision(positive) -> Column:
    tp, fp, _ = _binary(positive)
    return ratio_or_zero(tp, tp + fp)


def _f1(positive) -> Column:
    tp, fp, fn = _binary(positive)
    return ratio_or_zero(2 * tp, 2 * tp + fp + fn)


def _report(predictions: DataFrame, keys: Sequence[str], **metrics: Column) -> DataFrame:
    return pair_counts(predictions, keys).groupBy(*keys).agg(*[m.alias(name) for name, m in metrics.items()])


def accuracy(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _report(predictions, keys, accuracy=_accuracy())


def precision_binary(predictions: DataFrame, keys: Sequence[str] = (), positive=1) -> DataFrame:
    """TP / (TP + FP), 0 when nothing was predicted positive."""
    return _report(predictions, keys, precision=_precision(positive))


def f1_binary(predictions: DataFrame, keys: Sequence[str] = (), positive=1) -> DataFrame:
    """2 TP / (2 TP + FP + FN), 0 when undefined."""
    return _report(predictions, keys, f1_score=_f1(positive))


def per_class(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys.., class, support, precision, f1) for every class seen as label or prediction."""
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said"),
                 F.when(F.expr(CORRECT), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said"),
                 F.lit(0).cast("bigint").alias("tp")),
    )
    tall = pair_counts(predictions, keys).select(*keys, F.inline(sides))
    sums = tall.groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("support", "said", "tp")])
    return sums.select(
        *keys, "class", "support",
        ratio_or_zero(F.col("tp"), F.col("said")).alias("precision"),
        ratio_or_zero(2 * F.col("tp"), F.col("support") + F.col("said")).alias("f1_score"),
    )


def _weighted(predictions: DataFrame, keys: Sequence[str], *names: str) -> DataFrame:
    support = F.sum("support")
    return per_class(predictions, keys).groupBy(*keys).agg(
        *[ratio_or_zero(F.sum(F.col(n) * F.col("support")), support).alias(n) for n in names]
    )


def precision_weighted(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _weighted(predictions, keys, "precision")


def f1_weighted(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _weighted(predictions, keys, "f1_score")


def confusion_matrix(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Dense counts: one row per (keys.., label, prediction) of all classes of a key, zeros kept.

    The result itself has k x k rows per key. Classes come from the counts, not from the data, and
    are joined with themselves by key, so no row or task holds the list of a key's classes.
    """
    counts = pair_counts(predictions, keys)
    one = counts.withColumn("_all", F.lit(1))
    by = [*keys, "_all"]
    classes = one.select(*by, F.explode(F.array("label", "prediction")).alias("label")).distinct()
    grid = classes.join(classes.withColumnRenamed("label", "prediction"), by)
    found = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("label").alias("_label"), F.col("prediction").alias("_said"), "n")
    same = F.col("label").eqNullSafe(F.col("_label")) & F.col("prediction").eqNullSafe(F.col("_said"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return grid.join(found, same, "left").select(*keys, "label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def evaluation_report(predictions: DataFrame, keys: Sequence[str] = (), positive=1, weighted: bool = False) -> DataFrame:
    """Accuracy, precision and F1 of each model beside every cell of its dense matrix.

    One row per (keys.., label, prediction), so a model with many classes fills many rows, never one.
    """
    counts = pair_counts(predictions, keys)
    if weighted:
        scores = counts.groupBy(*keys).agg(_accuracy().alias("accuracy"))
        others = _weighted(predictions, keys, "precision", "f1_score")
    else:
        scores = counts.groupBy(*keys).agg(_accuracy().alias("accuracy"), _precision(positive).alias("precision"), _f1(positive).alias("f1_score"))
        others = None
    by = [*keys, "_all"]
    scores = scores.withColumn("_all", F.lit(1))
    if others is not None:
        scores = scores.join(others.withColumn("_all", F.lit(1)), by)
    cells = confusion_matrix(predictions, keys).withColumn("_all", F.lit(1))
    return cells.join(scores, by).select(*keys, "label", "prediction", "n", "accuracy", "precision", "f1_score")


def argmax(values: Column) -> Column:
    """0-based position of the first maximum of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
