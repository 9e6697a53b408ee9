"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes its words, A-Z lower-cased, joined by single spaces. Each rule is a regex over
whole words with a label, a keyword, a priority and a weight. A text that holds none of the
keywords is done after one cheap look at the raw text; any other is searched only by the rules
whose keyword it holds. Hits are ordered by start, longest first, then by priority and rule
number; one sweep that remembers how far hits have reached suppresses every hit that lies inside
an earlier one. The score is the largest weight of the hits that remain.

The three base phrases are rules like others, but all their places are counted and their labels
stay even where a longer hit contains them. Everything happens inside the row: no shuffle, no
join, so a license that fills a third of the table costs what any text costs.

Null texts are empty. Ids may be null or repeated. Other columns stay behind.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.llm.common import query, table

#: Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

_L = "licen[cs]e"
#: label, keyword (a word or the start of one), name as a regex over words.
NAMES = [
    ("mit", "mit licen", f"mit {_L}"), ("mit", "expat", f"expat {_L}"), ("apache-2", "apache", f"apache( software)?( {_L})?( version)? 2( 0)?"),
    ("apache-1", "apache", f"apache( software)?( {_L})?( version)? 1( [01])?"), ("gpl-3", "gnu", f"gnu general public {_L}( as published by the free software foundation)?( either)?( version)? 3( 0)?"),
    ("gpl-2", "gnu", f"gnu general public {_L}( as published by the free software foundation)?( either)?( version)? 2( 0)?"), ("gpl", "gnu", f"gnu general public {_L}"),
    ("gpl-3", "gpl", "gplv?( version)? ?v?3( 0)?"), ("gpl-2", "gpl", "gplv?( version)? ?v?2( 0)?"), ("gpl", "gpl", f"(gnu )?gpl( {_L})?"),
    ("lgpl-3", "lesser", f"gnu lesser general public {_L}( version)? 3( 0)?"), ("lgpl-2.1", "lesser", f"gnu lesser general public {_L}( version)? 2( 1)?"),
    ("lgpl", "lesser", f"gnu lesser general public {_L}"), ("lgpl", "lgpl", "lgpl( v?[23]( [01])?)?"), ("agpl-3", "affero", f"gnu affero general public {_L}( version)?( 3)?( 0)?"),
    ("agpl-3", "agpl", "agpl( v?3( 0)?)?"), ("bsd-3", "bsd", f"(3 clause|new|modified|revised) bsd( {_L})?"), ("bsd-3", "bsd", f"bsd 3 clause( {_L})?"),
    ("bsd-2", "bsd", f"(2 clause|simplified|freebsd) bsd( {_L})?"), ("bsd-2", "bsd", f"bsd 2 clause( {_L})?"), ("bsd", "bsd", f"bsd {_L}"),
    ("0bsd", "bsd", f"(zero clause bsd|0bsd)( {_L})?"), ("mpl-2", "mozilla", f"mozilla public {_L}( version)? 2( 0)?"), ("mpl-1.1", "mozilla", f"mozilla public {_L}( version)? 1 1"),
    ("mpl", "mozilla", f"mozilla public {_L}"), ("mpl", "mpl", "mpl( v?[12]( [01])?)?"), ("epl-2", "eclipse", f"eclipse public {_L}( version| v)? 2( 0)?"),
    ("epl-1", "eclipse", f"eclipse public {_L}( version| v)? 1( 0)?"), ("epl", "eclipse", f"eclipse public {_L}"), ("isc", "isc", f"isc {_L}"), ("zlib", "zlib", f"zlib( libpng)? {_L}"),
    ("unlicense", "unlicense", "the unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("artistic-2", "artistic", f"artistic {_L}( version)? 2( 0)?"), ("artistic", "artistic", f"artistic {_L}"),
    ("boost-1", "boost", f"boost software {_L}( version)?( 1( 0)?)?"), ("cc0", "cc0", "cc0( 1 0)?( universal)?"), ("cc0", "creative", "creative commons (zero|cc0)( 1 0)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd( [1234] 0)?"), ("cc-by-nc-sa", "cc", "cc by nc sa( [1234] 0)?"), ("cc-by-nc", "cc", "cc by nc( [1234] 0)?"),
    ("cc-by-nd", "cc", "cc by nd( [1234] 0)?"), ("cc-by-sa", "cc", "cc by sa( [1234] 0)?"), ("cc-by", "cc", "cc by( [1234] 0)?"),
    ("cc-by-nc-nd", "creative", f"creative commons attribution non ?commercial no ?deriv(s|atives)( [1234] 0)?( international)?( {_L})?"),
    ("cc-by-nc-sa", "creative", f"creative commons attribution non ?commercial share ?alike( [1234] 0)?( international)?( {_L})?"),
    ("cc-by-nc", "creative", f"creative commons attribution non ?commercial( [1234] 0)?( international)?( {_L})?"),
    ("cc-by-nd", "creative", f"creative commons attribution no ?deriv(s|atives)( [1234] 0)?( international)?( {_L})?"),
    ("cc-by-sa", "creative", f"creative commons attribution share ?alike( [1234] 0)?( international)?( {_L})?"),
    ("cc-by", "creative", f"creative commons attribution( [1234] 0)?( international)?( {_L})?"), ("public-domain", "domain", "public domain"),
    ("eupl", "european", f"european union public {_L}( v? ?1 [12])?"), ("cddl", "cddl", "cddl( 1 [01])?"), ("cddl", "distribution", f"common development and distribution {_L}"),
    ("odbl", "database", f"open (data commons open )?database {_L}"), ("ofl-1.1", "font", f"(sil )?open font {_L}( version)?( 1 1)?"), ("psf-2", "python", f"python software foundation {_L}( version)?( 2)?"),
    ("python", "python", f"python {_L}"), ("ruby", "ruby", f"ruby {_L}"), ("postgresql", "postgresql", f"postgresql {_L}"), ("openssl", "openssl", f"openssl {_L}"),
    ("ms-pl", "microsoft", f"microsoft public {_L}"), ("ms-rl", "microsoft", f"microsoft reciprocal {_L}"), ("gfdl", "documentation", f"gnu free documentation {_L}( version)?( 1 [123])?"),
    ("bsl-1.1", "business", f"business source {_L}( 1 1)?"), ("sspl", "server", f"server side public {_L}( v1)?"), ("elastic-2", "elastic", f"elastic {_L}( 2( 0)?)?"),
    ("proprietary", "proprietary", f"proprietary( software)? {_L}"), ("upl", "universal", f"universal permissive {_L}"), ("ncsa", "ncsa", f"ncsa( open source)? {_L}"),
]
#: Form name, words before and after the name, priority, weight.
FORMS = [
    ("notice", f"(is |are )?({_L}d|released|distributed|available|published|provided|offered|made available) (under|under the terms of|in accordance with|according to)( the)?( terms of)?( the)? ", "", 50, 0.95),
    ("spdx", f"spdx {_L} identifier ", "", 45, 1.0), ("field", f"{_L} (is )?(the )?", "", 30, 0.8), ("under", "under( the)?( terms of)?( the)? ", "", 25, 0.75), ("mention", "", "", 10, 0.5),
]


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, regex, priority, weight): every name in every form, the base phrases, then texts that need no name."""
    made = [(label, keyword, before + f"({name})" + after, priority, weight)
            for label, keyword, name in NAMES for _, before, after, priority, weight in FORMS]
    made += [(label, phrase, phrase, 60, 0.9) for phrase, label in BASE]
    made += [
        ("mit", "identifier mit", f"spdx {_L} identifier mit", 45, 1.0), ("all-rights-reserved", "rights", "all rights reserved", 20, 0.6), ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 40, 0.95),
        ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 40, 0.95),
        ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 55, 0.95),
        ("public-domain", "dedicated", "dedicated to the public domain", 40, 0.9), ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 55, 0.95),
    ]
    return made


def gate_words(made: list[tuple[str, str, str, int, float]]) -> list[str]:
    """Regexes of which every text with a hit holds one: `licen` where a rule can't do without it, else the first word of the rule's keyword."""
    words = set()
    for _, keyword, pattern, _, _ in made:
        sure = pattern
        while (less := re.sub(r"\([^()]*\)\?|\([^()]*\|[^()]*\)", "", sure)) != sure:
            sure = less
        words.add("licen" if "licen" in sure else keyword.split()[0])
    return sorted("(?<![0-9A-Za-z])cc(?![0-9A-Za-z])" if w == "cc" else w for w in words)


_RAW_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _starts(words: Column, pattern: Column) -> Column:
    """Pieces of `words` ('.' and ' w' per word and a last space), cut before every place where `pattern` begins, and their first word's number."""
    cut = F.split(words, F.concat(F.lit("(?= "), pattern, F.lit(" )")))
    ahead = F.transform(cut, lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "))))
    # Each piece after the first begins with a hit; the spaces before it are the words before it.
    sums = F.aggregate(ahead, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")),
                       lambda acc, x: F.struct((acc.n + x).alias("n"), F.concat(acc.at, F.array(acc.n)).alias("at")), lambda acc: acc.at)
    return F.struct(cut.alias("cut"), sums.alias("at"))


def _hits(words: Column, rule: Column) -> Column:
    """start, stop (exclusive), order and verdict of every place of one rule."""
    found = _starts(words, rule.pattern)
    whole = F.concat(F.lit("^ ("), rule.pattern, F.lit(")(?= )"))

    def hit(k: Column) -> Column:
        text = F.regexp_substr(F.array_join(F.slice(found.cut, k + 1, F.size(found.cut)), ""), whole)  # " w" per word
        start = F.get(found.at, k)
        return F.struct(start.alias("start"), (-(start + F.size(F.split(text, " ")) - 1)).alias("minus_stop"), (-rule.priority).alias("minus_priority"),
                        rule.number.alias("rule"), rule.label.alias("label"), rule.weight.alias("weight"))

    return F.transform(F.when(F.size(found.cut) > 1, F.sequence(F.lit(1), F.size(found.cut) - 1)).otherwise(F.array().cast("array<int>")), hit)


def _summed(sweep: Column, hit: Column) -> Column:
    inside = -hit.minus_stop <= sweep.reach
    kept = F.struct(hit.start.alias("first_word"), (-hit.minus_stop - 1).alias("last_word"), hit.rule.alias("rule"), hit.label.alias("label"), hit.weight.alias("weight"))
    return F.when(inside, sweep).otherwise(F.struct((-hit.minus_stop).alias("reach"), F.concat(sweep.kept, F.array(kept)).alias("kept")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base_starts (all places of base phrases), base_labels, and detections (first_word, last_word, rule, label, weight)."""
    table_of = rules()
    literal = F.array(*[F.struct(F.lit(i).alias("number"), F.lit(label).alias("label"), F.lit(key).alias("keyword"), F.lit(p).alias("pattern"),
                                 F.lit(rank).alias("priority"), F.lit(w).alias("weight")) for i, (label, key, p, rank, w) in enumerate(table_of)])
    gate = F.rlike(F.col("t"), F.lit("(?i)" + "|".join(gate_words(table_of))))
    words = F.concat(F.lit(". "), F.trim(F.regexp_replace(F.translate("t", _UPPER, _LOWER), _RAW_GAPS, " ")), F.lit(" "))
    base = F.transform(F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(label).alias("label")) for p, label in BASE]),
                       lambda r: F.struct(r.label.alias("label"), _starts(F.col("w"), r.pattern).alias("found")))
    places = F.transform(base, lambda b: F.struct(b.label.alias("label"), F.slice(b.found.at, 2, F.greatest(F.size(b.found.at), F.lit(1))).alias("at")))
    hits = F.array_sort(F.flatten(F.transform(F.filter(literal, lambda r: F.contains(F.col("w"), r.keyword)), lambda r: _hits(F.col("w"), r))))
    empty = "array<struct<first_word:int,last_word:int,rule:int,label:string,weight:double>>"
    detections = F.aggregate(hits, F.struct(F.lit(-1).alias("reach"), F.array().cast(empty).alias("kept")), _summed, lambda s: s.kept)
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
            .withColumn("w", F.when(gate, words))
            .select("doc_id", F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"),
                    F.when(F.col("w").isNotNull(), places).alias("places"), F.when(F.col("w").isNotNull(), detections).alias("detections"))
            .select("doc_id", "n_words", F.coalesce(F.flatten(F.transform("places", lambda p: p.at)), F.array().cast("array<int>")).alias("base_starts"),
                    F.coalesce(F.transform(F.filter("places", lambda p: F.size(p.at) > 0), lambda p: p.label), F.array().cast("array<string>")).alias("base_labels"),
                    F.coalesce("detections", F.array().cast(empty)).alias("detections")))


def oracle_sql() -> str:
    """The scan in SQL: every rule at every word of a text that holds its keyword, then the sweep as a running maximum."""
    made = rules()
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(label)}, {quoted(key)}, {quoted(p)}, {rank}, {weight})" for i, (label, key, p, rank, weight) in enumerate(made))
    base = ", ".join(str(i) for i, r in enumerate(made) if (r[2], r[0]) in BASE)
    return rf"""
    WITH rules AS (SELECT * FROM (VALUES {values}) AS r(rule, label, keyword, pattern, priority, weight)),
    d AS (SELECT row_number() OVER () AS rid, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    found AS (SELECT rid, ws, rule, label, pattern, priority, weight
              FROM d JOIN rules ON contains(concat('. ', array_to_string(ws, ' '), ' '), keyword)),
    places AS (SELECT *, unnest(range(len(ws))) AS start FROM found),
    m AS (SELECT *, regexp_extract(concat(array_to_string(ws[start + 1:start + 40], ' '), ' '), concat('^(', pattern, ') '), 1) AS hit FROM places),
    hits AS (SELECT rid, rule, label, priority, weight, start, start + len(string_split(hit, ' ')) AS stop FROM m WHERE hit <> ''),
    swept AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY rid ORDER BY start, stop DESC, priority DESC, rule
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach FROM hits),
    b AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits WHERE rule IN ({base}) GROUP BY rid),
    l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
          FROM swept WHERE stop > reach OR rule IN ({base}) GROUP BY rid),
    s AS (SELECT rid, max(weight) AS score FROM swept WHERE stop > reach GROUP BY rid)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)"""


@query("op10_licenses", oracle_sql())
def op10_licenses(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = F.array_union(F.transform("detections", lambda d: d.label), F.col("base_labels"))
    return found.select(
        "doc_id", "n_words", F.size("base_starts").cast("long").alias("n_base"), F.array_min("base_starts").cast("long").alias("first_word"),
        F.array_max("base_starts").cast("long").alias("last_word"), F.array_join(F.array_sort(F.array_distinct("base_labels")), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d.weight)), F.lit(0.0)).alias("score"))
