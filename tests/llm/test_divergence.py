import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tallyforge.llm.divergence import Pointers, divergence, equal_runs, op12_divergence

RNG = random.Random(12)
WORDS = ["the", "The", "aa", "ab", "a", "straße", "Élan", "élan", "日本語", "abcdefgh", "abcdefghi", "x" * 24, "x" * 25, "x" * 60, "x" * 60 + "y"]


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, min_docs, top):
    rows = [(lang or "", source or "", terms_of(text)) for text, lang, source in rows]
    df, groups = defaultdict(Counter), {}
    for lang, source, ws in rows:
        df[lang].update(set(ws))
        groups.setdefault((lang, source), Counter()).update(ws)
    kept = {lang: {t for t, n in c.items() if n >= min_docs} for lang, c in df.items()}

    def shares(lang, count):
        total = sum(count[t] for t in kept[lang])
        return {t: 1 + 10 ** 9 * (count[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    p = {g: shares(g[0], c) for g, c in groups.items()}
    q = {lang: shares(lang, sum((c for g, c in groups.items() if g[0] == lang), Counter())) for lang in kept}
    out = []
    for (lang, source), mine in p.items():
        parts = {"pair": [(sum(abs(mine[t] - p[g][t]) for t in mine), g[1]) for g in p if g[0] == lang and g[1] != source],
                 "term": [(mine[t] - q[lang][t], t) for t in mine if groups[lang, source][t] and mine[t] > q[lang][t]]}
        for part, found in parts.items():
            found.sort(key=lambda f: (-f[0], f[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def made(n, sources, langs=("en", "de", None)):
    words = WORDS + [f"{a}{b}" for a in "qrstuv" for b in "abcdefghijkl"]
    return [(" ".join(RNG.choices(words, k=RNG.randint(0, 40))) if i % 17 else RNG.choice([None, "", "1 2 3,"]), RNG.choice(langs), RNG.choice(sources)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").selectExpr(
        "doc_id", "text", "lang", "source", "'x' AS term", "1 AS value", "2 AS p", "3 AS v", "4 AS rank")


@pytest.mark.parametrize("n", [0, 1, 50, 3000, 60000])
def test_pointers_are_sorted_and_runs_are_equal_terms(n):
    texts = ["".join(RNG.choice([*WORDS, " ", ",", "1", "é"]) + RNG.choice(["", " "]) for _ in range(RNG.randint(0, 30))) for _ in range(n // 8)] + ["", "ab", "ab"]
    whole = pa.array(["skip", *texts])[1:]
    pointers = Pointers(whole)
    found = [pointers.data[s:s + k].tobytes().decode() for s, k in zip(pointers.starts, pointers.lengths)]
    assert found == [t for x in texts for t in terms_of(x)]
    assert [int(t) for t in pointers.texts] == [i for i, x in enumerate(texts) for _ in terms_of(x)]
    shard = pointers.texts % 3
    order, first = equal_runs(pointers, shard)
    want = sorted(range(len(found)), key=lambda i: (shard[i], found[i].encode(), i))
    assert [(shard[i], found[i]) for i in order] == [(shard[i], found[i]) for i in want] and list(order) == want
    keys = [(shard[i], found[i]) for i in order]
    assert list(first) == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]
    assert pointers.text_of(order).to_pylist() == [found[i] for i in order]


def test_equals_plain_version(spark):
    rows = made(900, [f"s{i}" for i in range(9)] + [None, "", "é"])
    rows += [("rare words only", "fr", "lone"), (None, "it", "a"), ("", "it", "b"), ("x " * 50000, "en", "long")] + [("same text again", "es", "copies")] * 300
    docs = frame(spark, rows)
    for options in (dict(min_docs=30, top=50), dict(min_docs=5, top=3, slice_bytes=2000, terms_a_block=7, sources_a_block=3)):
        got = sorted(map(tuple, divergence(docs, **options).collect()))
        want = plain(rows, options["min_docs"], options["top"])
        assert len(got) == len(want) and [(a, b) for a, b in zip(got, want) if a != b][:3] == []


def test_empty_table_and_types(spark):
    df = divergence(frame(spark, [("a", "en", "s")]).where("false"))
    assert df.collect() == [] and dict(df.dtypes)["value"] == "bigint" and dict(df.dtypes)["rank"] == "int"


def test_registered_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()]
    got = sorted(map(tuple, op12_divergence(spark, sf).select("lang", "source", "part", "item", "value", "rank").collect()))
    want = plain(rows, 30, 50)
    assert len(got) == len(want) and [(a, b) for a, b in zip(got, want) if a != b][:3] == []
