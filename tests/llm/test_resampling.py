import hashlib
import math
import random
import re
import zlib

import pytest

from tallyforge.llm import resampling
from tallyforge.llm.resampling import _keyed, cutoff, resample, weighted_median

RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(60)] + ["Éa", "ÉA", "x1y", "日本"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, target, ngrams=(1, 1), buckets=10_000, seed=2024, min_words=20, percent=10):
    def features(text):
        ws = words_of(text)
        return [zlib.crc32(" ".join(ws[i:i + n]).encode()) % buckets for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(ws) - n + 1)]

    docs, want = [(i, len(words_of(t)), features(t)) for i, t in rows], [b for t in target for b in features(t)]
    s, t = [0] * buckets, [0] * buckets
    for b in want:
        t[b] += 1
    for _, _, f in docs:
        for b in f:
            s[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    ranks = {id(r): k + 1 for k, r in enumerate(order[:percent * len(order) // 100])}
    return sorted(((r[0], *r[2:], ranks.get(id(r))) for r in out), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def same(found, wanted):
    """Equal, with a short report of what isn't."""
    assert len(found) == len(wanted) and [(a, b) for a, b in zip(found, wanted) if a != b][:3] == []


@pytest.fixture(scope="module")
def rows():
    made = [(i, " ".join(RNG.choices(WORDS, k=RNG.randint(0, 60)))) for i in range(400)]
    return made + [(None, None), (None, "w1 " * 30), (500, None), (501, ""), (502, " ,;\n"), (7, "w2 w3 " * 20), (7, "w2 w3 " * 20), (7, "w9"), (503, "w5-W6 " * 30000)]


def test_equals_plain_version(docs_of, spark, rows):
    target = ["w1 w2 w3 É", None, "", "W4 w5 x1y"]
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    same(got(resample(docs_of(rows, extra=True), wanted)), plain(rows, target))
    kinds = dict(resample(docs_of(rows[:30]), wanted).dtypes)
    assert kinds == {c: "bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")}
    # Pairs of words, other sizes, tiny chunks: the same by many passes.
    some = dict(ngrams=(1, 2), buckets=50, seed=3, min_words=5, percent=40)
    same(got(resample(docs_of(rows).repartition(7), wanted, chunk=16, last=4, **some)), plain(rows, target, **some))


def test_empty_tables_and_empty_target(docs_of, spark):
    none = spark.createDataFrame([], "text string")
    assert resample(docs_of([]), none).collect() == []
    rows = [(i, "a b " * (i + 5)) for i in range(40)]
    assert got(resample(docs_of(rows), none)) == plain(rows, [])
    assert got(resample(docs_of(rows), none, percent=0)) == plain(rows, [], percent=0)
    assert got(resample(docs_of(rows), none, percent=100)) == plain(rows, [], percent=100)


def test_cutoff_with_ties(spark):
    values = [(RNG.choice([1, 1, 1, 5, 9]) if i % 2 else RNG.randint(-50, 50), RNG.choice([None, 1, 2, i])) for i in range(900)]
    keys = _keyed(spark.createDataFrame([(s, d, 3) for s, d in values], "score long, doc_id long, n_features long").repartition(6)).persist()
    order = sorted((-s, int(d is None), d or 0, 3) for s, d in values)
    for need in (1, 2, 90, 450, 899, 900):
        assert cutoff(keys, need, chunk=40, last=10) == order[need - 1]


def test_every_pass_drops_a_quarter():
    draw = random.Random(1)
    parts = [sorted((draw.randint(0, 99),) for _ in range(draw.randint(1, 200))) for _ in range(50)]
    pivot = weighted_median([(p[(len(p) - 1) // 2], len(p)) for p in parts])
    rows = [k for p in parts for k in p]
    assert min(sum(k <= pivot for k in rows), sum(k >= pivot for k in rows)) >= len(rows) / 4


def test_registered_query(spark, sf):
    table = lambda name: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").selectExpr("text" if name == "benchmark" else "doc_id", "text").collect()]
    rows, target = table("documents"), [t for _, t in table("benchmark")]
    assert got(resampling.op13_resampling(spark, sf)) == plain(rows, target)
