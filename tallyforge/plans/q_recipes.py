"""The tabular preparation recipes, from cleaning to scaling, on tables with their real column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge.operators import prep, recipes
from tallyforge.plans.q_prep import md5_part
from tallyforge.plans.registry import query
from tallyforge.sources.tables import table

TEST_BELOW = 858993459


def _q(name: str) -> str:
    return f'"{name}"'


def raw(spark, folder, columns: dict[str, str], source: str = "lineitem") -> DataFrame:
    """A table with the recipe's columns out of one of the given tables; the expressions are the SQL's own."""
    spark_sql = ", ".join(f"{e} AS `{c}`" for c, e in columns.items())
    return spark.sql(f"SELECT {spark_sql} FROM {{source}}", source=table(spark, folder, source))


def raw_sql(columns: dict[str, str], source: str = "lineitem") -> str:
    return f"SELECT {', '.join(f'{e} AS {_q(c)}' for c, e in columns.items())} FROM {source}"


def code(column: str) -> str:
    """Class code by rank of the distinct values; NULL is the class after the last."""
    return f"""CASE WHEN {_q(column)} IS NULL THEN (SELECT count(DISTINCT {_q(column)}) FROM clean)
        ELSE (SELECT k FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT {_q(column)} AS v FROM clean)
              WHERE v IS NOT NULL) WHERE v = t.{_q(column)}) END AS {_q(column)}"""


def recipe_sql(clean: str, columns: list[str], label: str, encoded: list[str], scaled: list[str], stratified: bool = False) -> str:
    """Codes, split by hash of the key, and scaling by the train part over `clean` (row_key, columns.., label)."""
    codes = ", ".join(code(c) if c in encoded else _q(c) for c in columns)
    kept = code(label) if label in encoded else _q(label)
    split = f"CASE WHEN {md5_part("concat(row_key, '|42')")} < {TEST_BELOW} THEN 'test' ELSE 'train' END"
    if stratified:
        split = f"""CASE WHEN row_number() OVER (PARTITION BY {_q(label)} ORDER BY {md5_part("concat(row_key, '|42')")},
            {md5_part("concat(row_key, '|43')")}, row_key) <= ceil(count(*) OVER (PARTITION BY {_q(label)}) * CAST(0.2 AS DOUBLE))
            THEN 'test' ELSE 'train' END"""
    stats = ", ".join(f"avg({_q(c)}::DOUBLE) AS m{i}, coalesce(nullif(stddev_pop({_q(c)}::DOUBLE), 0), 1) AS s{i}" for i, c in enumerate(scaled))
    out = ", ".join(f"round((p.{_q(c)} - m{scaled.index(c)}) / s{scaled.index(c)}, 6) AS {_q(c)}" if c in scaled else f"p.{_q(c)}" for c in columns)
    return f"""WITH clean AS ({clean}), coded AS (SELECT row_key, {codes}, {kept} FROM clean AS t),
        parts AS (SELECT *, {split} AS split FROM coded), stats AS (SELECT {stats} FROM parts WHERE split = 'train')
        SELECT row_key, {out}, p.{_q(label)}, split FROM parts AS p, stats"""


KEY = "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))"

WINE = {"row_key": KEY, "fixed acidity": "l_quantity", "volatile acidity": "l_discount", "residual sugar": "l_tax", "alcohol": "l_extendedprice",
        "quality": "CAST(3 + l_quantity % 6 AS INT)"}


@query("recipe_wine", recipe_sql(f"""SELECT * REPLACE (CASE WHEN quality >= 6 THEN 1 ELSE 0 END AS quality) FROM ({raw_sql(WINE)})""",
                                 list(WINE)[1:-1], "quality", [], list(WINE)[1:-1]))
def recipe_wine(spark, folder):
    return _rounded(recipes.wine(raw(spark, folder, WINE), key="row_key"), list(WINE)[1:-1])


CREDIT = {"row_key": KEY, "ID": "l_orderkey", "LIMIT_BAL": "l_extendedprice", "AGE": "CAST(20 + l_quantity AS INT)", "PAY_0": "l_linenumber",
          "BILL_AMT1": "l_extendedprice * l_discount", "default.payment.next.month": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"}
CREDIT_FEATURES = ["LIMIT_BAL", "AGE", "PAY_0", "BILL_AMT1"]


@query("recipe_credit", recipe_sql(f"""SELECT * EXCLUDE ("ID", "default.payment.next.month"), "default.payment.next.month" AS "default"
    FROM ({raw_sql(CREDIT)})""", CREDIT_FEATURES, "default", [], CREDIT_FEATURES))
def recipe_credit(spark, folder):
    return _rounded(recipes.credit(raw(spark, folder, CREDIT), key="row_key"), CREDIT_FEATURES)


CONNECTIONS = {"row_key": KEY, "duration": "l_quantity", "protocol_type": "l_returnflag", "service": "concat('m', CAST(l_suppkey % 7 AS STRING))", "flag": "l_linestatus",
               "src_bytes": "CAST(floor(l_extendedprice) AS BIGINT)", "count": "l_linenumber", "same_srv_rate": "l_discount",
               "label": "CASE WHEN l_tax < 0.05 THEN 'normal.' WHEN l_linenumber = 1 THEN 'smurf.' END"}
CONNECTION_FEATURES = list(CONNECTIONS)[1:-1]


@query("recipe_connections", recipe_sql(f"""SELECT * REPLACE (CASE WHEN label = 'normal.' THEN 0 ELSE 1 END AS label) FROM ({raw_sql(CONNECTIONS)})""",
                                        CONNECTION_FEATURES, "label", ["protocol_type", "service", "flag"], CONNECTION_FEATURES))
def recipe_connections(spark, folder):
    return _rounded(recipes.connections(raw(spark, folder, CONNECTIONS), key="row_key"), CONNECTION_FEATURES)


FLOWS = {"row_key": KEY, "id": "l_orderkey", "dur": "CAST(l_discount AS DOUBLE)", "proto": "l_returnflag", "service": "CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('m', CAST(l_suppkey % 7 AS STRING)) END",
         "state": "l_linestatus", "spkts": "CAST(l_partkey AS BIGINT)", "sbytes": "CAST(floor(l_extendedprice) AS BIGINT)", "attack_cat": "concat('m', CAST(l_suppkey % 7 AS STRING))",
         "label": "CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END"}
FLOW_FEATURES, FLOW_NUMBERS = ["dur", "proto", "service", "state", "spkts", "sbytes"], ["dur", "spkts", "sbytes"]


@query("recipe_flows", recipe_sql(f"""SELECT * EXCLUDE (id, attack_cat) FROM ({raw_sql(FLOWS)}) WHERE service IS NOT NULL""",
                                  FLOW_FEATURES, "label", ["proto", "service", "state"], FLOW_NUMBERS, stratified=True))
def recipe_flows(spark, folder):
    return _rounded(recipes.flows(raw(spark, folder, FLOWS), key="row_key"), FLOW_NUMBERS)


CENSUS = {
    "row_key": KEY, "age": "l_quantity", "workclass": "CASE l_linenumber WHEN 1 THEN 'Private' WHEN 2 THEN '?' WHEN 3 THEN 'Local-gov' ELSE 'Without-pay' END",
    "fnlwgt": "l_extendedprice", "education": "CASE l_returnflag WHEN 'A' THEN 'HS-grad' WHEN 'N' THEN 'Bachelors ' ELSE 'Doctorate' END",
    "marital-status": "CASE l_linestatus WHEN 'O' THEN 'Divorced' ELSE 'Married-civ-spouse' END",
    "occupation": "CASE l_suppkey % 3 WHEN 0 THEN 'Sales' WHEN 1 THEN 'Craft-repair' ELSE '?' END",
    "relationship": "CASE WHEN l_suppkey % 2 = 0 THEN 'Husband' ELSE 'Own-child' END", "race": "CASE WHEN l_partkey % 3 = 0 THEN 'White' ELSE 'Black' END",
    "gender": "CASE WHEN l_partkey % 2 = 0 THEN 'Male' ELSE 'Female' END", "capital-gain": "l_discount", "capital-loss": "l_tax",
    "hours-per-week": "CAST(l_linenumber AS DOUBLE)", "native-country": "CASE WHEN l_orderkey % 5 = 0 THEN '?' ELSE 'United-States' END",
    "income": "CASE WHEN l_extendedprice * l_discount > 2000 THEN '>50K' ELSE '<=50K' END",
}
CENSUS_NUMBERS = ["age", "fnlwgt", "hours-per-week"]
CENSUS_CODED = [*recipes.CENSUS_MAPS, *recipes.CENSUS_KEEP, "gender", "income"]
CENSUS_FEATURES = [c for c in CENSUS if c not in ("row_key", "income", *recipes.CENSUS_DROPPED)]


def _census_sql() -> str:
    quartiles = ", ".join(f"quantile_cont({_q(c)}, 0.25) AS a{i}, quantile_cont({_q(c)}, 0.75) AS b{i}" for i, c in enumerate(CENSUS_NUMBERS))
    steps = {c: f"greatest(least({_q(c)}, b{i} + 1.5 * (b{i} - a{i})), a{i} - 1.5 * (b{i} - a{i}))" for i, c in enumerate(CENSUS_NUMBERS)}
    for c, mapping in recipes.CENSUS_MAPS.items():
        steps[c] = f"CASE {_q(c)} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())} END"
    for c, keep in recipes.CENSUS_KEEP.items():
        steps[c] = f"CASE WHEN {_q(c)} = '{keep}' THEN '{keep}' ELSE 'Other' END"
    columns = ", ".join(f"{steps.get(c, _q(c))} AS {_q(c)}" for c in CENSUS if c not in recipes.CENSUS_DROPPED)
    return f"""SELECT {columns} FROM (SELECT DISTINCT * FROM ({raw_sql(CENSUS)})), (SELECT {quartiles} FROM (SELECT DISTINCT * FROM ({raw_sql(CENSUS)})))"""


@query("recipe_census", recipe_sql(_census_sql(), CENSUS_FEATURES, "income", CENSUS_CODED, CENSUS_FEATURES))
def recipe_census(spark, folder):
    """Every row twice in the input; split and scaled as they are, before any oversampling."""
    once = raw(spark, folder, CENSUS)
    return _rounded(recipes.census(once.unionByName(once), key="row_key"), CENSUS_FEATURES)


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fixes the last bits of floating sums, whose order differs between engines."""
    return df.select(*[F.round(prep.quoted(c), 6).alias(c) if c in columns else prep.quoted(c) for c in df.columns])
