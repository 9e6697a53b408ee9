import random
import re

import numpy as np
import pytest

from tallyforge.llm.mixing import flight, land, mix, op11_mixing

RNG = random.Random(11)


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, share=1.5, most=2):
    """Shares by weight, capped and reshared until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: most * sizes[s] for s in full}
        left, open_ = left - sum(target[s] for s in full), open_ - full
    return target


def check(rows, got, slack):
    sizes, taken = {}, {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    target = plain_targets(sizes)
    assert sorted((str(i), s, size_of(t)) for i, s, t in [(i, str(s), t) for i, s, t in rows]) == sorted((str(r.doc_id), str(r.source), r.size) for r in got)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        if sizes[r.source]:
            ratio = target[r.source] / sizes[r.source]
            assert np.floor(ratio) <= r.copies <= np.ceil(ratio)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - target[source]) <= slack, (source, words, target[source])
    return target


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "2 AS target", "3 AS chance", "4 AS copies", "5 AS block")


@pytest.fixture(scope="module")
def rows():
    made = [(i, RNG.choice(["a", "a", "a", "b", "c", "É", None, "tiny"]), "w " * min(400, int(RNG.paretovariate(1.1) * 3))) for i in range(3000)]
    made = [(i, s, t) for i, s, t in made if s != "tiny"] + [(9000, "tiny", "one two")]
    return made + [(None, "a", None), (None, "b", ""), (None, None, "x y"), (5, "none", None), (6, "none", " \t\n"), (7, "c", "same one")] + [(8, "c", "copy of this")] * 300 + [(10, "a", "long " * 1500)]


def test_targets_sums_and_rows(spark, rows):
    got = mix(frame(spark, rows), block=1000).collect()
    # Words of the last few documents decide; the sizes here are small but for one.
    target = check(rows, got, slack=2)
    assert target["tiny"] == 4
    # Documents are balanced too: about as many rows get one more as the chances add up to.
    for source in ("a", "b", "c", None):
        mine = [r for r in got if r.source == source]
        ratio = mine[0].target / mine[0].source_size
        assert abs(sum(r.copies for r in mine) - ratio * len(mine)) <= 12


def test_same_rows_in_any_partitioning(spark, rows):
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.copies)
    once, again = (sorted(map(key, mix(frame(spark, rows).repartition(n), block=64).collect())) for n in (1, 13))
    assert once == again
    other = sorted(map(key, mix(frame(spark, rows), seed=2).collect()))
    assert other != once


def test_flight_keeps_both_sums_and_chances():
    draw = np.random.default_rng(0)
    size = np.where(draw.random(400) < 0.3, 7, draw.integers(0, 5000, 400))
    hits = np.zeros(400)
    for k in range(300):
        chance = np.full(400, 0.3)
        moved = flight(chance, size, np.random.default_rng(k), stop=2)
        assert abs(moved.sum() - chance.sum()) < 1e-6 and abs((moved * size).sum() - (chance * size).sum()) < 1e-3
        assert ((moved > 0) & (moved < 1)).sum() <= 2
        hits += moved
    assert abs(hits.mean() / 300 - 0.3) < 1e-3 and np.abs(hits / 300 - 0.3).max() < 0.12


def test_landing_is_the_best_outcome():
    draw = np.random.default_rng(3)
    for _ in range(20):
        chance, size = draw.random(6), draw.integers(1, 100, 6)
        done = land(chance, size)
        best = min(abs((np.array([(k >> j) & 1 for j in range(6)]) - chance) @ size) for k in range(64))
        assert set(done) <= {0.0, 1.0} and abs((done - chance) @ size) == pytest.approx(best, abs=1e-5)
    assert list(land(np.array([0.0, 1.0]), np.array([3, 4]))) == [0.0, 1.0]


def test_empty_tables_and_no_words(spark):
    assert mix(frame(spark, [])).collect() == []
    got = mix(frame(spark, [(1, "a", None), (2, None, "")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


def test_registered_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    source = {i: s for i, s, _ in rows}
    found = op11_mixing(spark, sf)
    assert dict(found.dtypes) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint", "copies": "bigint"}
    from pyspark.sql import Row
    got = [Row(**r.asDict(), source=source[r.doc_id]) for r in found.collect()]
    largest = {}
    for i, s, t in rows:
        largest[s] = max(largest.get(s, 0), size_of(t))
    check(rows, got, slack=max(largest.values()) / 2)
