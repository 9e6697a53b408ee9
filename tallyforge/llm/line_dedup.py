"""Line dedup by overlapping three-line windows.

Lines that hold a word are numbered within their document; every three consecutive ones make
a window, named by 128 bits of hash. A window seen more than once keeps its first occurrence,
by (doc_id, place), and gives up all later ones; the lines that given-up windows cover are
merged per document and removed, whatever else covers them.

Only windows move between tasks, never texts, and a window that fills a third of the table is
one partial minimum per task. The look-up of later occurrences is a plain join with one row a
key on one side, which adaptive execution splits where a key is hot.

Lines without a word stay where they are. Texts of fewer than three lines with words have no
window and stay whole, as do null texts and rows with a null doc_id (they have no place in the
order). Rows that share a doc_id are one document: their windows at equal places don't count
against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.llm.common import query, table
from tallyforge.session import settle

WIDTH = 3


def line_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, at (places of the window's lines in the text, 0-based), and its hash (a, b)."""
    lines = F.filter(
        F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"),
                                                                        F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")).alias("word"))),
        lambda s: s.word)
    starts = F.when(F.size("ls") >= width, F.sequence(F.lit(0), F.size("ls") - width)).otherwise(F.array().cast("array<int>"))
    window = F.transform(starts, lambda k: F.struct(
        F.transform(F.slice("ls", k + 1, width), lambda s: s.i).alias("at"),
        F.xxhash64(*[F.get("ls", k + j).a for j in range(width)]).alias("a"),
        F.xxhash64(F.lit(2), *[F.get("ls", k + j).b for j in range(width)]).alias("b")))
    return (docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", lines.alias("ls"))
            .select("doc_id", F.explode(window).alias("w")).select("doc_id", "w.at", "w.a", "w.b"))


def removed_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and `gone`, the places of its lines that lie in a window seen earlier."""
    windows = settle(line_windows(docs, width))
    place = F.struct("doc_id", F.col("at")[0].alias("i"))
    firsts = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = windows.join(firsts, ["a", "b"]).where(F.struct("doc_id", F.col("at")[0].alias("i")) != F.col("first"))
    return later.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("gone"))


def _flags(gone: str) -> Column:
    """True at the places in the sorted column `gone`, false before and between them, so that a line is looked up in constant time."""
    before = lambda k: F.coalesce(F.get(gone, k - 1), F.lit(-1))
    return F.flatten(F.transform(gone, lambda g, k: F.concat(F.array_repeat(F.lit(False), g - before(k) - 1), F.array(F.lit(True)))))


def line_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """`docs` with later repeats cut out of `text`, and the columns `n_lines`, `n_removed` (replaced if there)."""
    docs = docs.drop("n_lines", "n_removed")
    gone = removed_lines(docs.select("doc_id", "text"), width).select(
        F.col("doc_id").alias("_id"), F.size("gone").alias("_size"), _flags("gone").alias("_gone"))
    joined = docs.join(gone, docs.doc_id == gone._id, "left")
    lines = F.split(F.col("text"), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get("_gone", i), F.lit(False))), "\n"))
    return (joined.withColumns({"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
                                "n_removed": F.coalesce("_size", F.lit(0)).cast("long"), "text": text})
            .select(*(f"`{c}`" for c in docs.columns), "n_lines", "n_removed"))


ORACLE = r"""
WITH l AS (SELECT doc_id, i - 1 AS i, xs[i] AS x FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS i
           FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))),
w AS (SELECT doc_id, i, lead(i, 1) OVER o AS j, lead(i, 2) OVER o AS k, [x, lead(x, 1) OVER o, lead(x, 2) OVER o] AS g
      FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM w WHERE k IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([i, j, k]) AS i FROM f WHERE r > 1),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
                string_agg(x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text
         FROM l LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.doc_id IS NULL OR d.text IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""


@query("op6_line_dedup", ORACLE)
def op6_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
