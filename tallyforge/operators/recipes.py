"""Whole preparation recipes: raw table in, scaled train/test table out.

A recipe first cleans and encodes (deterministic, comparable with SQL), then
optionally resamples, splits and scales. Rows are keyed by a hash of their content,
so copies of a row land in the same part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tallyforge.operators import prep
from tallyforge.session import settle

Resampler = Callable[[DataFrame, str], DataFrame]

# How the census columns are merged into coarser groups. Keys are matched
# exactly, trailing blanks included.
WORKCLASS = {
    "Private": "private", "Self-emp-not-inc": "self-employed", "Local-gov": "government", "State-gov": "government",
    "Self-emp-inc": "self-employed", "Federal-gov": "government", "Without-pay": "other", "Never-worked": "other",
}
EDUCATION = {
    "HS-grad": "learning", "Some-college": "learning", "Bachelors ": "graduate", "Masters": "graduate",
    "Assoc-voc": "assoc", "11th": "child", "Assoc-acdm": "assoc", "10th": "child", "7th-8th": "child",
    "Prof-school": "graduate", "9th": "child", "12th": "child", "Doctorate": "gruduate", "5th-6th ": "child",
    "1st-4th  ": "child", "Preschool": "child",
}
MARITAL_STATUS = {
    "Married-civ-spouse": "married", "Never-married": "single", "Divorced": "single", "Separated": "single",
    "Widowed": "single", "Married-spouse-absent": "married", "Married-AF-spouse": "married",
}
OCCUPATION = {
    "Prof-specialty": "professional and executive", "Craft-repair": "labor and manufacturing",
    "Exec-managerial": "professional and executive", "Adm-clerical": "professional and executive",
    "Sales": "sales and services", "Other-service": "sales and services",
    "Machine-op-inspct": "labor and manufacturing", "Transport-moving": "labor and manufacturing",
    "Handlers-cleaners": "labor and manufacturing", "Farming-fishing ": "labor and manufacturing",
    "Tech-suppor": "sales and services", "Protective-serv": "sales and services",
    "Priv-house-serv": "sales and services", "Armed-Forces ": "sales and services",
}
RELATIONSHIP = {
    "Husband": "spouse", "Not-in-family": "others:", "Own-child": "immediate family", "Unmarried": "others:",
    "Wife": "spouse", "Other-relative": "immediate family",
}
CENSUS_MAPS = {"workclass": WORKCLASS, "education": EDUCATION, "marital-status": MARITAL_STATUS,
               "occupation": OCCUPATION, "relationship": RELATIONSHIP}
CENSUS_KEEP = {"race": "White", "native-country": "United-States"}
CENSUS_DROPPED = ["capital-gain", "capital-loss"]
TEST_SHARE = 0.2
SEED = 42


def content_key(df: DataFrame, out: str = "row_key") -> DataFrame:
    """Adds an md5 over all columns of the row."""
    return df.withColumn(out, F.md5(F.to_json(F.struct(*[prep.quoted(c) for c in df.columns])).cast("binary")))


def split_and_scale(df: DataFrame, label: str, scaled: list[str] | None = None, stratified: bool = False,
                    resample: Resampler | None = None, key: str | None = None) -> DataFrame:
    """Rows (row_key, features.., label, split), scaled by the train part.

    `key` names a column that already tells rows apart; without it the content does.
    """
    ready = df if resample is None else resample(df, label)
    keyed = content_key(ready) if key is None else ready.withColumnRenamed(key, "row_key")
    if stratified:
        parts = prep.stratified_split(keyed, "row_key", label, TEST_SHARE, SEED)
    else:
        parts = prep.random_split(keyed, "row_key", TEST_SHARE, SEED)
    columns = scaled if scaled is not None else [c for c in df.columns if c not in (label, key)]
    # Read by the fit and by the result: codes and splits are found once.
    return prep.standard_scale(settle(parts), columns, F.col("split") == "train")


def clean_census(df: DataFrame, sketch: bool = False) -> DataFrame:
    """Income table: missing marks, copies, outliers, coarse groups, codes; label `income`."""
    # Read by the quantile passes and by the rest: the deduplicated table is written once.
    df = settle(prep.drop_duplicates(prep.sentinel_to_null(df)))
    df = prep.iqr_clip(df, sketch=sketch)
    for column, mapping in CENSUS_MAPS.items():
        df = prep.map_values(df, column, mapping)
    for column, keep in CENSUS_KEEP.items():
        df = prep.collapse_to_other(df, column, keep)
    df = prep.label_encode(df, [*CENSUS_MAPS, *CENSUS_KEEP, "gender", "income"])
    return prep.drop_columns(df, CENSUS_DROPPED)


def clean_connections(df: DataFrame) -> DataFrame:
    """Connection log: codes for text columns, label 0 for normal traffic."""
    encoded = prep.label_encode(df, ["protocol_type", "service", "flag"])
    return prep.binarize_equals(encoded, "label", "normal.")


def clean_flows(df: DataFrame, key: str | None = None) -> DataFrame:
    """Network flows: id and attack category dropped, incomplete rows dropped, text encoded."""
    df = prep.drop_missing(prep.drop_columns(df, ["id", "attack_cat"]))
    return prep.label_encode(df, [c for c in prep.columns_of(df, prep.TEXT) if c != key])


def clean_wine(df: DataFrame) -> DataFrame:
    return prep.binarize_threshold(df, "quality", 6)


def clean_credit(df: DataFrame) -> DataFrame:
    renamed = prep.rename_column(df, "default.payment.next.month", "default")
    return prep.drop_columns(renamed, ["ID"])


def census(df: DataFrame, resample: Resampler | None = None, sketch: bool = False, key: str | None = None) -> DataFrame:
    """Balances before the split, as the published numbers of this table do."""
    return split_and_scale(clean_census(df, sketch), "income", resample=resample, key=key)


def connections(df: DataFrame, key: str | None = None) -> DataFrame:
    return split_and_scale(clean_connections(df), "label", key=key)


def flows(df: DataFrame, key: str | None = None) -> DataFrame:
    """Scales only the columns that were numeric before encoding; stratified split."""
    numeric = [c for c in prep.columns_of(df, prep.NUMERIC) if c not in ("id", "attack_cat", "label")]
    return split_and_scale(clean_flows(df, key), "label", scaled=numeric, stratified=True, key=key)


def wine(df: DataFrame, key: str | None = None) -> DataFrame:
    return split_and_scale(clean_wine(df), "quality", key=key)


def credit(df: DataFrame, key: str | None = None) -> DataFrame:
    return split_and_scale(clean_credit(df), "default", key=key)


def images(df: DataFrame, shape: tuple[int, int, int], key: str = "idx") -> DataFrame:
    """Pixels to [0, 1], split, nested as height x width x channels."""
    scaled = df.withColumn("pixels", prep.pixel_normalize(F.col("pixels")))
    split = prep.random_split(scaled, key, TEST_SHARE, SEED)
    return split.withColumn("pixels", prep.reshape_array(F.col("pixels"), shape))
