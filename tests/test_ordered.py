"""Ranks, running totals and threshold lookups against plain Python, with hot paths forced."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.ordered import above_threshold, exact_rank, running_totals, with_pieces


def rows(n, seed=1):
    draw = random.Random(seed)
    # Key 0 owns half the rows; the value 7 owns a third of them.
    return [(i, 0 if draw.random() < 0.5 else draw.randrange(1, 9), 7 if draw.random() < 0.33 else draw.randrange(-50, 1000))
            for i in range(n)]


@pytest.mark.parametrize("hot_rows", [5, 10**6])
@pytest.mark.parametrize("part", [["k"], []])
def test_exact_rank(spark, hot_rows, part):
    data = rows(3000)
    df = spark.createDataFrame(data, "id bigint, k int, v bigint")
    got = {r["id"]: r["rn"] for r in exact_rank(df, part, ["v", "id"], hot_rows=hot_rows).collect()}
    want, seen = {}, {}
    for i, k, v in sorted(data, key=lambda r: (r[2], r[0])):
        group = k if part else 0
        seen[group] = seen.get(group, 0) + 1
        want[i] = seen[group]
    assert got == want


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_exact_rank_of_text(spark, hot_rows):
    words = sorted({f"{p}{i}" for p in ("", "a", "Customer#", "Ünï", "zz") for i in range(120)} | {""}, key=lambda w: w.encode())
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(5)
    got = {r["w"]: r["rn"] for r in exact_rank(df, [], ["w"], hot_rows=hot_rows).collect()}
    assert got == {w: i + 1 for i, w in enumerate(words)}


def test_exact_rank_null_keys_and_empty(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 3), (3, 1, 9)], "id bigint, k int, v bigint")
    got = {r["id"]: r["rn"] for r in exact_rank(df, ["k"], ["v"], hot_rows=1).collect()}
    assert got == {2: 1, 1: 2, 3: 1}
    assert exact_rank(df.filter("id < 0"), [], ["v"]).count() == 0
    assert exact_rank(df.filter("id < 0"), ["k"], ["v"]).count() == 0


@pytest.mark.parametrize("hot_rows", [4, 10**6])
def test_running_totals(spark, hot_rows):
    draw = random.Random(2)
    times = sorted(draw.sample(range(10**12, 10**12 + 500), 300) + [1, 2])
    data = [(t, draw.randrange(-3, 4)) for t in times]
    df = spark.createDataFrame(data, "t bigint, d bigint").repartition(6)
    got = {r["t"]: r["total"] for r in running_totals(df, "t", {"d": "total"}, hot_rows=hot_rows).collect()}
    total, want = 0, {}
    for t, d in data:
        total += d
        want[t] = total
    assert got == want


@pytest.mark.parametrize("hot_rows", [4, 10**6])
@pytest.mark.parametrize("total", [False, True])
def test_above_threshold(spark, hot_rows, total):
    draw = random.Random(3)
    items = [(g, float(draw.randrange(0, 60)), draw.randrange(0, 1000)) for g in ("a", "b") for _ in range(150)]
    needs = [(g, float(n)) for g in ("a", "b", "c") for n in (draw.randrange(-5, 70) for _ in range(80))]
    left = spark.createDataFrame(items, "g string, free double, pay bigint")
    right = spark.createDataFrame(needs, "g string, need double")
    got = {(r["g"], r["need"]): r["out"] for r in
           above_threshold(left, right, ["g"], "free", "need", F.col("pay"), "out", total, hot_rows).collect()}
    want = {}
    for g, need in set(needs):
        fit = [p for k, free, p in items if k == g and free > need]
        want[g, need] = sum(fit) if total else min(fit, default=None)
    assert got == want


def test_partition_counts_do_not_matter(spark):
    df = spark.createDataFrame(rows(500), "id bigint, k int, v bigint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, exact_rank(df, ["k"], ["v", "id"], hot_rows=20).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_pieces_follow_the_rows_of_each_part(spark):
    # 60 large parts whose orders don't overlap, one with an outlier, one with text that shares its beginning.
    data = [(k, 1000 * k + i, f"shared-prefix-{i:04d}") for k in range(60) for i in range(100)] + [(0, 10**15, "z")]
    df = spark.createDataFrame(data, "k int, v bigint, w string")
    for order in (["v"], ["w", "v"]):
        pieces, cut = with_pieces(df, ["k"], order, hot_rows=20)
        sizes = pieces.groupBy("k", "_piece").count()
        assert cut and sizes.agg(F.max("count")).first()[0] <= 20
        assert sizes.groupBy("k").count().agg(F.max("count")).first()[0] <= 40
    assert not with_pieces(df, ["k"], ["v"], hot_rows=1000)[1]


def test_many_equal_values_are_cut_by_the_next_column(spark):
    df = spark.createDataFrame([(5, i) for i in range(300)], "v bigint, id bigint")
    pieces, _ = with_pieces(df, [], ["v", "id"], hot_rows=50)
    assert pieces.groupBy("_piece").count().agg(F.max("count")).first()[0] <= 50
