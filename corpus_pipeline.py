"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result to the
shared folder and reads it back as the next stage's docs. All but the last return the columns of
documents. Rows with a null doc_id pass the stages that need an identity unchanged: they keep
their lines, and near-dedup keeps them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.llm.byte_bpe import digests
from tallyforge.llm.common import table
from tallyforge.llm.decontamination import with_leaks
from tallyforge.llm.line_dedup import line_dedup
from tallyforge.llm.quality import quality_cascade
from tallyforge.llm.shingles import similar_groups
from tallyforge.session import settle

SHINGLE_WORDS = 5


def _hidden(docs: DataFrame) -> DataFrame:
    """`docs` with every column but doc_id and text renamed, so that no operator's column meets one of the same name."""
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"doc:{c}") for c in docs.columns if c not in ("doc_id", "text")))


def _shown(result: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `docs` out of a result on `_hidden(docs)`."""
    return result.select(*(changed.get(c, F.col(c if c in ("doc_id", "text") else f"`doc:{c}`")).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return _shown(quality_cascade(_hidden(docs)).where("kept"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have; `n_chars` follows the text. Documents of which no word is left go."""
    done = line_dedup(_hidden(docs))
    kept = done.where((F.col("n_removed") == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    return _shown(kept, docs, n_chars=F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("`doc:n_chars`")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by shingle similarities from 0.8: the one with the smallest doc_id, of several with it the one with the smallest text hash. Repeated rows of it are one document."""
    keyed = _hidden(docs).where("doc_id IS NOT NULL").withColumn("text:key", F.xxhash64("text"))
    found = similar_groups(keyed.select("doc_id", "text:key", "text"), SHINGLE_WORDS)
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "text:key")).alias("of")).select("of.*").distinct()
    kept = keyed.join(first, ["doc_id", "text:key"], "left_semi").dropDuplicates(["doc_id", "text:key"])
    return _shown(kept, docs).unionByName(docs.where("doc_id IS NULL"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _shown(with_leaks(_hidden(docs), table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0), docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return digests(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]

#: The latent space and the encoder can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
