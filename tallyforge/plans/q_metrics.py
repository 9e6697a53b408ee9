"""Queries over evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import metrics as ops
from tallyforge.plans.q_runlog import rounded
from tallyforge.plans.registry import query
from tallyforge.plans.views import view
from tallyforge.sources.tables import table

BINARY_SQL = "SELECT c1, label, CASE WHEN x1 >= 25 THEN 1 ELSE 0 END AS prediction FROM v_tab"
MULTI_SQL = """SELECT l_returnflag, l_linenumber AS label,
    CAST(1 + (l_linenumber - 1 + CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) % 6 AS INTEGER) AS prediction FROM lineitem"""


def binary(spark, folder):
    """A one-rule classifier: large quantity predicts the expensive class."""
    return view(spark, folder, "v_tab").select("c1", "label", F.when(F.col("x1") >= 25, 1).otherwise(0).alias("prediction"))


def multi(spark, folder):
    """Seven true classes, of which the last is never predicted."""
    shift = F.when(F.col("l_quantity") > 40, 1).otherwise(0)
    return table(spark, folder, "lineitem").select(
        "l_returnflag", F.col("l_linenumber").alias("label"),
        (1 + (F.col("l_linenumber") - 1 + shift) % 6).cast("int").alias("prediction"),
    )


TP = "count(*) FILTER (WHERE label = 1 AND prediction = 1)"
FP = "count(*) FILTER (WHERE label <> 1 AND prediction = 1)"
FN = "count(*) FILTER (WHERE label = 1 AND prediction <> 1)"
ACCURACY = "CAST(count(*) FILTER (WHERE label = prediction) AS DOUBLE) / count(*)"
PRECISION = f"coalesce(CAST({TP} AS DOUBLE) / nullif({TP} + {FP}, 0), 0)"
F1 = f"coalesce(CAST(2 * {TP} AS DOUBLE) / nullif(2 * {TP} + {FP} + {FN}, 0), 0)"


@query("accuracy", f"SELECT c1, {ACCURACY} AS accuracy FROM ({BINARY_SQL}) AS p GROUP BY c1")
def accuracy(spark, folder):
    return ops.accuracy(binary(spark, folder), ["c1"])


@query("precision_binary", f"SELECT c1, {PRECISION} AS precision FROM ({BINARY_SQL}) AS p GROUP BY c1")
def precision_binary(spark, folder):
    return ops.precision_binary(binary(spark, folder), ["c1"])


@query("f1_binary", f"SELECT c1, {F1} AS f1_score FROM ({BINARY_SQL}) AS p GROUP BY c1")
def f1_binary(spark, folder):
    return ops.f1_binary(binary(spark, folder), ["c1"])


PER_CLASS_SQL = f"""SELECT g.l_returnflag, k.class,
        count(*) FILTER (WHERE label = k.class) AS support,
        coalesce(CAST(count(*) FILTER (WHERE label = k.class AND prediction = k.class) AS DOUBLE)
                 / nullif(count(*) FILTER (WHERE prediction = k.class), 0), 0) AS p,
        coalesce(CAST(2 * count(*) FILTER (WHERE label = k.class AND prediction = k.class) AS DOUBLE)
                 / nullif(count(*) FILTER (WHERE label = k.class) + count(*) FILTER (WHERE prediction = k.class), 0), 0) AS f
    FROM ({MULTI_SQL}) AS g, (SELECT DISTINCT l_linenumber AS class FROM lineitem) AS k GROUP BY g.l_returnflag, k.class"""


@query("precision_weighted", f"""SELECT l_returnflag, round(sum(p * support) / sum(support), 9) AS precision
    FROM ({PER_CLASS_SQL}) AS c GROUP BY l_returnflag""")
def precision_weighted(spark, folder):
    return rounded(ops.precision_weighted(multi(spark, folder), ["l_returnflag"]), "precision", digits=9)


@query("f1_weighted", f"""SELECT l_returnflag, round(sum(f * support) / sum(support), 9) AS f1_score
    FROM ({PER_CLASS_SQL}) AS c GROUP BY l_returnflag""")
def f1_weighted(spark, folder):
    return rounded(ops.f1_weighted(multi(spark, folder), ["l_returnflag"]), "f1_score", digits=9)


@query("confusion_matrix", f"""WITH p AS ({MULTI_SQL}), k AS (SELECT label AS c FROM p UNION SELECT prediction FROM p)
    SELECT a.c AS label, b.c AS prediction, count(p.label) AS n
    FROM k AS a CROSS JOIN k AS b LEFT JOIN p ON p.label = a.c AND p.prediction = b.c GROUP BY a.c, b.c""")
def confusion_matrix(spark, folder):
    return ops.confusion_matrix(multi(spark, folder))


@query("confusion_matrix_by_key", f"""WITH p AS ({MULTI_SQL}), k AS (SELECT l_returnflag, label AS c FROM p UNION SELECT l_returnflag, prediction FROM p)
    SELECT a.l_returnflag, a.c AS label, b.c AS prediction, count(p.label) AS n
    FROM k AS a JOIN k AS b USING (l_returnflag) LEFT JOIN p ON p.l_returnflag = a.l_returnflag AND p.label = a.c AND p.prediction = b.c
    GROUP BY a.l_returnflag, a.c, b.c""")
def confusion_matrix_by_key(spark, folder):
    return ops.confusion_matrix(multi(spark, folder), ["l_returnflag"])


@query("evaluation_report", f"""WITH p AS ({BINARY_SQL}), s AS (SELECT {ACCURACY} AS accuracy, {PRECISION} AS precision, {F1} AS f1_score FROM p),
    k AS (SELECT label AS c FROM p UNION SELECT prediction FROM p)
    SELECT a.c AS label, b.c AS prediction, count(p.label) AS n, any_value(accuracy) AS accuracy, any_value(precision) AS precision,
        any_value(f1_score) AS f1_score
    FROM s CROSS JOIN k AS a CROSS JOIN k AS b LEFT JOIN p ON p.label = a.c AND p.prediction = b.c GROUP BY a.c, b.c""")
def evaluation_report(spark, folder):
    return ops.evaluation_report(binary(spark, folder))


@query("evaluation_report_weighted", f"""WITH p AS ({MULTI_SQL}), a AS (SELECT l_returnflag, {ACCURACY} AS accuracy FROM p GROUP BY l_returnflag),
    w AS (SELECT l_returnflag, round(sum(p * support) / sum(support), 9) AS precision, round(sum(f * support) / sum(support), 9) AS f1_score
          FROM ({PER_CLASS_SQL}) AS c GROUP BY l_returnflag),
    k AS (SELECT l_returnflag, label AS c FROM p UNION SELECT l_returnflag, prediction FROM p)
    SELECT x.l_returnflag, x.c AS label, y.c AS prediction, count(p.label) AS n, any_value(accuracy) AS accuracy,
        any_value(precision) AS precision, any_value(f1_score) AS f1_score
    FROM k AS x JOIN k AS y USING (l_returnflag) JOIN a USING (l_returnflag) JOIN w USING (l_returnflag)
    LEFT JOIN p ON p.l_returnflag = x.l_returnflag AND p.label = x.c AND p.prediction = y.c GROUP BY x.l_returnflag, x.c, y.c""")
def evaluation_report_weighted(spark, folder):
    """Weighted scores and the dense matrix of seven classes, for each return flag."""
    return rounded(ops.evaluation_report(multi(spark, folder), ["l_returnflag"], weighted=True), "precision", "f1_score", digits=9)


@query("batch_score", """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted
    FROM embeddings""")
def batch_score(spark, folder):
    """Arg-max over the class scores of each row; the first maximum wins."""
    return table(spark, folder, "embeddings").select("vec_id", ops.argmax(F.col("embedding")).alias("predicted"))
