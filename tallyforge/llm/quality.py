"""Quality rules as a short-circuit cascade.

Each rule looks at the statistics of one text and says whether it rejects it. On a bounded
sample every rule is run on every text, which gives its cost and its selectivity; rules are
then ordered by rejections per second, and a text leaves the cascade at the first rule that
rejects it. The verdict is "no rule rejects", so it doesn't depend on the order found.

Null texts have no words. Null ids and repeated rows are judged row by row like any other.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import arrow_map, arrow_rows, extended, query, table

SYMBOLS = "#*$%&|<>"
_ALPHA = re.compile(r"[^\W\d_]")
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f�]")


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window which occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = numbers[:-1] * len(ids) + numbers[1:]
    if len(ids) >= 1 << 20:  # three numbers no longer fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(ids) + numbers[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= again
    return int(covered.sum())


class Stats:
    """Figures of one text that the rules share; the dearer ones are found when a rule asks."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = self.text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly \x20 and \x09-\x0D
        self.n_words = len(self.words)
        self.word_chars = len(self.text) - sum(self.text.count(c) for c in " \t\n\x0b\x0c\r")
        self.n_symbols = sum(self.text.count(c) for c in SYMBOLS)
        lines = [x for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words = repeated_words(self.words)
        self.lines = lines

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


#: Rule by name: true if the text is rejected. Counts only, so that SQL can say the same.
RULES: dict[str, Callable[[Stats], bool]] = {
    # More than one symbol in ten words: markup, tables, decorated words.
    "symbols": lambda s: 10 * s.n_symbols > s.n_words,
    # More than six lines in ten repeat an earlier one; fewer are left to the line stage.
    "duplicate_lines": lambda s: 10 * s.n_dup_lines > 6 * s.n_lines,
    # Mean word length outside 2 to 20 code points.
    "word_length": lambda s: s.word_chars < 2 * s.n_words or s.word_chars > 20 * s.n_words,
    # Fewer than six words in ten hold a letter.
    "letters": lambda s: 10 * sum(1 for w in s.words if _ALPHA.search(w.decode("utf-8", "replace"))) < 6 * s.n_words,
    # More than one code point in a hundred is a control or replacement character.
    "broken_text": lambda s: 100 * len(_ODD.findall(s.text)) > s.word_chars,
    # More than nine lines in ten open with a bullet.
    "bullets": lambda s: 10 * sum(x.lstrip().startswith(("- ", "* ", "•")) for x in s.lines) > 9 * s.n_lines,
    # More than three lines in ten end with an ellipsis.
    "ellipses": lambda s: 10 * sum(x.rstrip().endswith(("...", "…")) for x in s.lines) > 3 * s.n_lines,
}

_OUT = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
                  ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])


def rule_order(docs: DataFrame, sample_rows: int = 2000) -> list[str]:
    """Rule names by rejections per second on at most `sample_rows` texts, found by a hash of the text.

    Only figures per rule come to the driver. The sample steers the order, never a verdict.
    """
    total = docs.count()
    picked = docs.select("text")
    if total > sample_rows:
        share = max(1, total // sample_rows)
        picked = picked.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    names = list(RULES)

    def measure(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, seen = [0.0] * len(names), [0] * len(names), 0
        for (text,) in arrow_rows(stream):
            stats = Stats(text)
            if stats.base_failed:
                continue
            seen += 1
            for k, name in enumerate(names):
                began = time.perf_counter()
                rejected[k] += bool(RULES[name](stats))
                seconds[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": names, "seen": [seen] * len(names), "rejected": rejected, "seconds": seconds})

    figures = (picked.transform(arrow_map, measure, "rule string, seen long, rejected long, seconds double")
               .groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect())
    gain = {r.rule: (r.rejected + 0.01) / (r.seconds + 1e-9) for r in figures}
    return sorted(names, key=lambda n: (-gain.get(n, 0.0), n))


def quality_cascade(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """`docs` with the word statistics, `base_failed`, `kept` and `rejected_by` (the first rule that fired, or `base`).

    Columns of `docs` that bear one of these names are replaced.
    """
    order = order or rule_order(docs)
    added = [f.name for f in _OUT]
    carried = [c for c in docs.columns if c not in added]
    at = carried.index("text")

    def judge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            rows = []
            for start in range(0, batch.num_rows, 256):
                for text in batch.column(at).slice(start, 256).to_pylist():
                    s = Stats(text)
                    by = "base" if s.base_failed else next((n for n in order if RULES[n](s)), None)
                    rows.append((s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed, by is None, by))
            new = [pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*carried, *added])

    plain = docs.select(*(f"`{c}`" for c in carried))
    return plain.transform(arrow_map, judge, extended(plain.schema, "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                            "n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines,
              count(*) FILTER (regexp_matches(x, '^\s*(- |\* |•)')) AS n_bullets, count(*) FILTER (regexp_matches(x, '(\.\.\.|…)\s*$')) AS n_ellipses
       FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
s AS (SELECT t.rid, t.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets,
             coalesce(n_ellipses, 0) AS n_ellipses, len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_letters,
             len(regexp_extract_all(text, '[\x00-\x08\x0e-\x1f\x7f\x{FFFD}]')) AS n_odd
      FROM t JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN ln USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 6 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_letters < 6 * n_words OR 100 * n_odd > word_chars
            OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines) AS kept
FROM s
"""


@query("op5_quality", ORACLE)
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
