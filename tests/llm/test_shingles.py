import random

import numpy as np

import corpus_pipeline as cp
from tallyforge.llm import shingles
from tallyforge.llm.simhash import _hashes


def reworded(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return out


def made():
    """Texts with copies of all degrees, a large group around one text, and a passage that half of them share."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for k in range(70):
        base = [word() for _ in range(rng.randint(60, 260))] + (passage if k % 2 else [])
        texts.append(base)
        texts += [reworded(base, rng.randint(1, max(1, len(base) // 20)), rng) for _ in range(3)]
    hub = [word() for _ in range(150)]
    texts += [reworded(hub, rng.randint(1, 5), rng) for _ in range(80)]
    chain = [word() for _ in range(200)]
    texts += [chain[:], chain[15:] + [word() for _ in range(15)], chain[30:] + [word() for _ in range(30)]]
    return [" ".join(t) for t in texts] + ["one two", "One TWO", "", None, " "]


def plain(texts):
    sets = [set(_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def test_groups_equal_all_pairs_from_four_fifths(spark, docs_of):
    texts = made()
    got = {}
    for r in shingles.similar_groups(docs_of(list(enumerate(texts))).select("doc_id", "text")).collect():
        got.setdefault(r.group, []).append(r.doc_id)
    want = plain(texts)
    assert sorted(map(sorted, got.values())) == sorted([i for i, w in enumerate(want) if w == g] for g in set(want))


def test_stage_keeps_the_first_of_each_group(spark, docs_of):
    texts = made()
    want = plain(texts)
    kept = {r.doc_id for r in cp.near_dedup_stage(spark, docs_of(list(enumerate(texts))), "").collect()}
    assert kept == set(want)


def test_prefixes_of_alike_sets_share_enough():
    rng = np.random.default_rng(2)
    for n in (1, 4, 5, 19, 20, 100, 333):
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 62, n))
            away = int(rng.integers(0, n // 9 + 1))
            y = np.unique(np.concatenate([x[away:], rng.integers(0, 1 << 62, away)]))
            if 5 * len(np.intersect1d(x, y)) < 4 * len(np.union1d(x, y)):
                continue
            order = shingles.Order({int(v): 2 + k % 3 for k, v in enumerate(np.concatenate([x[::3], y[::2]]))})
            assert len(np.intersect1d(order.prefix(x), order.prefix(y))) >= shingles._least(min(len(x), len(y)))


def test_unlike_texts_of_one_doc_id_both_stay(spark, docs_of):
    rng = random.Random(9)
    one, two, three = (" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(3))
    rows = [(1, one), (1, two), (1, two), (2, two + " end"), (3, three), (0, three), (None, three)]
    kept = [(r.doc_id, r.text) for r in cp.near_dedup_stage(spark, docs_of(rows, extra=True), "").collect()]
    assert len(kept) == 4 and set(kept) == {(1, one), (1, two), (0, three), (None, three)}


def test_fingerprints_link_near_copies_through_the_trees(spark, docs_of):
    """Of a large group of near copies fingerprints alone link nearly all, by fewer pairs than members times fingerprints; bands add only pairs still apart."""
    rng = random.Random(5)
    hub = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [" ".join(reworded(hub, 1, rng)) for _ in range(60)] + [" ".join(f"w{rng.randrange(5000)}" for _ in range(90)) for _ in range(20)]
    sets = shingles.settle(shingles.shingle_sets(docs_of(list(enumerate(texts))).select("doc_id", "text"), 5).select("node", "shingles"))
    pairs = shingles.settle(shingles._fingerprinted(sets))
    links = shingles.settle(shingles.alike(pairs, sets))
    assert links.count() <= pairs.count() < shingles.FINGERPRINTS * 80
    assert shingles.components(links).groupBy("root").count().agg({"count": "max"}).first()[0] >= 50
    assert shingles._apart(links, links).count() == 0
