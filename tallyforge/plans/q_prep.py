"""Queries over feature-preparation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import prep as ops, sketches
from tallyforge.plans.q_runlog import rounded
from tallyforge.plans.registry import query
from tallyforge.plans.views import view
from tallyforge.session import scratch_path, settle
from tallyforge.sources.tables import table

XS = ["x1", "x2", "x3", "x4"]
# The test tables carry no '?', so a regular value plays the sentinel.
SENTINEL = "N"
TEST_LIMIT = 858993459  # round(0.2 * 2^32)


def md5_part(expr: str, start: int = 1) -> str:
    return f"CAST('0x' || substr(md5({expr}), {start}, 8) AS BIGINT)"


def tab(spark, folder):
    return view(spark, folder, "v_tab")


def tab_with_nulls(spark, folder):
    return ops.sentinel_to_null(tab(spark, folder), SENTINEL, ["c1"])


TAB_NULLS_SQL = f"SELECT row_key, nullif(c1, '{SENTINEL}') AS c1, c2, x1, x2, x3, x4, label FROM v_tab"


@query("sentinel_columns", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", coalesce(bool_or({c} = '{SENTINEL}'), false) AS has_sentinel FROM v_tab"""
    for c in ("row_key", "c1", "c2")))
def sentinel_columns(spark, folder):
    return ops.sentinel_columns(tab(spark, folder), SENTINEL)


@query("sentinel_to_null", f"""SELECT row_key, nullif(c1, '{SENTINEL}') AS c1, nullif(c2, '{SENTINEL}') AS c2,
    x1, x2, x3, x4, label FROM v_tab""".replace("row_key,", f"nullif(row_key, '{SENTINEL}') AS row_key,", 1))
def sentinel_to_null(spark, folder):
    return ops.sentinel_to_null(tab(spark, folder), SENTINEL)


@query("drop_duplicates", "SELECT DISTINCT * FROM v_tab")
def drop_duplicates(spark, folder):
    both = tab(spark, folder)
    return ops.drop_duplicates(both.unionByName(both))


QUANTILES_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({p} AS DOUBLE) AS prob, round(quantile_cont({c}, {p}), 6) AS value FROM v_tab"""
    for c in XS for p in (0.25, 0.75))


@query("quantiles", QUANTILES_SQL)
def quantiles(spark, folder):
    return rounded(ops.quantiles(tab(spark, folder), XS), "value")


@query("quantiles_refreshed", " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST({p} AS DOUBLE) AS prob, count({c}) AS n, true AS near FROM v_tab"""
                                                 for c in XS for p in (0.25, 0.75)))
def quantiles_refreshed(spark, folder):
    """Twelve parts that arrive in three appends, each sketched once; the ranks of the merged quantiles are right to twice the stated error."""
    rows, path = tab(spark, folder), scratch_path(spark, "sketches")
    part = F.pmod(F.xxhash64("row_key"), F.lit(12))
    for upto in (4, 8, 12):
        sketches.refresh_sketches(rows.filter(part < upto), path, part, XS)
    found = settle(sketches.sketched_quantiles(sketches.stored_sketches(spark, path)))
    # Two counts per quantile, in one pass over the rows.
    counted = rows.agg(F.array(*[F.struct(F.lit(r["column"]).alias("column"), F.lit(r["prob"]).alias("prob"), F.count_if(F.col(r["column"]) < r["value"]).alias("below"),
                                          F.count_if(F.col(r["column"]) <= r["value"]).alias("upto")) for r in found.collect()]).alias("all")).select(F.inline("all"))
    slack = 2 * sketches.rank_error() * F.col("n")
    near = (F.col("below") - slack <= F.col("prob") * F.col("n")) & (F.col("prob") * F.col("n") <= F.col("upto") + slack)
    return found.join(counted, ["column", "prob"]).select("column", "prob", "n", near.alias("near"))


LIMITS_SQL = "SELECT " + ", ".join(
    f"""quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c},
        quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"""
    for c in XS) + " FROM v_tab"


def clip_sql(column: str) -> str:
    return f"round(CASE WHEN {column} < lo_{column} THEN lo_{column} WHEN {column} > hi_{column} THEN hi_{column} ELSE {column} END, 6) AS {column}"


@query("iqr_clip", f"""WITH limits AS ({LIMITS_SQL})
    SELECT row_key, c1, c2, {', '.join(clip_sql(c) for c in XS)}, label FROM v_tab, limits""")
def iqr_clip(spark, folder):
    return rounded(ops.iqr_clip(tab(spark, folder), XS), *XS)


@query("select_by_dtype", "SELECT row_key, x1, x2, x3, x4 FROM v_tab")
def select_by_dtype(spark, folder):
    return ops.select_by_dtype(tab(spark, folder), ops.NUMERIC, keep=["row_key"])


@query("map_values", """SELECT row_key, CASE c1 WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' END AS c1
    FROM v_tab""")
def map_values(spark, folder):
    """'N ' has a trailing blank and so never matches: N becomes NULL."""
    mapping = {"A": "accepted", "R": "returned", "N ": "none"}
    return ops.map_values(tab(spark, folder).select("row_key", "c1"), "c1", mapping)


@query("map_values_table", """SELECT c_custkey, n_name AS nation FROM customer
    LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 4""")
def map_values_table(spark, folder):
    """Dictionary held as a table; nations of the last region are left out, so some keys do not match."""
    nations = table(spark, folder, "nation").filter("n_regionkey < 4")
    mapping = nations.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return ops.map_values_table(customers, "c_nationkey", mapping, "nation").select("c_custkey", "nation")


@query("collapse_to_other", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'Other' END AS lang FROM documents")
def collapse_to_other(spark, folder):
    return ops.collapse_to_other(table(spark, folder, "documents").select("doc_id", "lang"), "lang", "en")


def encode_sql(source: str, column: str) -> str:
    """Class code by subqueries: number of smaller classes, or all of them for NULL."""
    return f"""coalesce((SELECT code FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM
        (SELECT DISTINCT {column} AS v FROM {source} WHERE {column} IS NOT NULL) AS d) AS k WHERE k.v = t.{column}),
        (SELECT count(DISTINCT {column}) FROM {source})) AS {column}"""


@query("label_encode", f"""WITH src AS ({TAB_NULLS_SQL})
    SELECT row_key, {encode_sql('src', 'c1')}, {encode_sql('src', 'c2')} FROM src AS t""")
def label_encode(spark, folder):
    return ops.label_encode(tab_with_nulls(spark, folder).select("row_key", "c1", "c2"), ["c1", "c2"])


@query("binarize_equals", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS o_orderstatus FROM orders")
def binarize_equals(spark, folder):
    return ops.binarize_equals(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F")


@query("binarize_threshold", "SELECT row_key, coalesce(CAST(nullif(x1, 50) >= 25 AS INTEGER), 0) AS x1 FROM v_tab")
def binarize_threshold(spark, folder):
    """The value 50 is made missing first: missing counts as below the threshold."""
    source = tab(spark, folder).select("row_key", F.nullif(F.col("x1"), F.lit(50.0)).alias("x1"))
    return ops.binarize_threshold(source, "x1", 25)


@query("rename_column", """SELECT row_key, label AS "default" FROM v_tab""")
def rename_column(spark, folder):
    dotted = tab(spark, folder).select("row_key", F.col("label").alias("default.payment.next.month"))
    return ops.rename_column(dotted, "default.payment.next.month", "default")


@query("drop_columns", "SELECT ts, user_id, event_type, value FROM events")
def drop_columns(spark, folder):
    return ops.drop_columns(table(spark, folder, "events"), ["event_id", "props"])


@query("drop_missing", f"SELECT * FROM ({TAB_NULLS_SQL}) AS t WHERE c1 IS NOT NULL")
def drop_missing(spark, folder):
    return ops.drop_missing(tab_with_nulls(spark, folder))


@query("features_target", "SELECT row_key, x1 AS f0, x2 AS f1, x3 AS f2, x4 AS f3, label FROM v_tab")
def features_target(spark, folder):
    pairs = ops.features_target(tab(spark, folder), "label", keep=["row_key", "c1", "c2"])
    return pairs.select("row_key", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(4)], "label")


SPLIT_SQL = f"""SELECT *, CASE WHEN {md5_part("concat(row_key, '|42')")} < {TEST_LIMIT} THEN 'test' ELSE 'train' END
    AS split FROM v_tab"""


@query("random_split", SPLIT_SQL)
def random_split(spark, folder):
    return ops.random_split(tab(spark, folder), "row_key")


@query("stratified_split", f"""WITH r AS (SELECT row_key, label,
        row_number() OVER (PARTITION BY label ORDER BY {md5_part("concat(row_key, '|42')")},
                           {md5_part("concat(row_key, '|43')")}, row_key) AS rank_in_class,
        count(*) OVER (PARTITION BY label) AS n FROM v_tab)
    SELECT row_key, label, CASE WHEN rank_in_class <= ceil(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
    FROM r""")
def stratified_split(spark, folder):
    return ops.stratified_split(tab(spark, folder).select("row_key", "label"), "row_key", "label")


def scale_sql(columns) -> str:
    parts = [f"round(({c} - (SELECT avg({c}) FROM s WHERE split = 'train')) / "
             f"(SELECT stddev_pop({c}) FROM s WHERE split = 'train'), 6) AS {c}" if c in columns else c for c in XS]
    return f"WITH s AS ({SPLIT_SQL}) SELECT row_key, {', '.join(parts)}, label, split FROM s"


def _scaled(spark, folder, columns):
    split = ops.random_split(tab(spark, folder), "row_key").drop("c1", "c2")
    return rounded(ops.standard_scale(split, columns, F.col("split") == "train"), *columns)


@query("standard_scale", scale_sql(XS))
def standard_scale(spark, folder):
    return _scaled(spark, folder, XS)


@query("standard_scale_subset", scale_sql(["x1", "x2"]))
def standard_scale_subset(spark, folder):
    return _scaled(spark, folder, ["x1", "x2"])


@query("pixel_normalize", """SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(embedding[i + 1] AS DOUBLE) / 255.0 AS pixel
    FROM embeddings, unnest(range(0, len(embedding))) AS t(i)""")
def pixel_normalize(spark, folder):
    images = table(spark, folder, "embeddings").select("vec_id", ops.pixel_normalize(F.col("embedding")).alias("p"))
    return images.select("vec_id", F.posexplode("p").alias("pos", "pixel"))


@query("reshape_array", """SELECT vec_id, CAST(i // 8 AS INTEGER) AS row, CAST(i % 8 AS INTEGER) AS col,
    CAST(0 AS INTEGER) AS channel, CAST(embedding[i + 1] AS DOUBLE) AS value
    FROM embeddings, unnest(range(0, len(embedding))) AS t(i)""")
def reshape_array(spark, folder):
    """64 values as an 8 x 8 x 1 image, shown with their coordinates."""
    images = table(spark, folder, "embeddings").select("vec_id", ops.reshape_array(F.col("embedding"), [8, 8, 1]).alias("a"))
    return (
        images.select("vec_id", F.posexplode("a").alias("row", "b"))
        .select("vec_id", "row", F.posexplode("b").alias("col", "c"))
        .select("vec_id", "row", "col", F.posexplode("c").alias("channel", "value"))
        .withColumn("value", F.col("value").cast("double"))
    )


@query("shape_report", f"""WITH twice AS (SELECT * FROM ({TAB_NULLS_SQL}) AS a UNION ALL SELECT * FROM ({TAB_NULLS_SQL}) AS b),
    once AS (SELECT DISTINCT * FROM twice)
    SELECT 'loaded' AS stage, count(*) AS n_rows, 8 AS n_columns FROM twice
    UNION ALL SELECT 'deduplicated', count(*), 8 FROM once
    UNION ALL SELECT 'complete', count(*), 8 FROM once WHERE c1 IS NOT NULL""")
def shape_report(spark, folder):
    one = tab_with_nulls(spark, folder)
    loaded = one.unionByName(one)
    deduplicated = ops.drop_duplicates(loaded)
    return ops.shape_report({"loaded": loaded, "deduplicated": deduplicated, "complete": ops.drop_missing(deduplicated)})
