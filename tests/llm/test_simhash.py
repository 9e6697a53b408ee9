import random

import numpy as np
import pytest
import xxhash

from tallyforge.llm import simhash
from tallyforge.llm.components import components


def plain_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, k=4, bits=4):
    fps = [plain_fingerprint(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            groups[find(i)] = min(groups.get(find(i), doc), doc)
    return sorted(((d, fps[i], groups.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_fingerprint_is_the_plain_one():
    for text in (None, "", "  \n", "One", "A b  C\td", "é È\x0bA  z " * 40, "w " * 70_000):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_of_texts(docs_of):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(140):
        parts = rng.choice(base).split()
        if i % 3:
            parts[rng.randrange(len(parts))] = "zz"
        rows.append((1000 + i, " ".join(parts)))
    rows += [(5, rows[5][1]), (None, base[0]), (None, "alone words here"), (2000, None), (2001, ""), (2002, " \n")]
    got = simhash.near_dedup(docs_of(rows, extra=True), sample_rows=16, shard_rows=8).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_of_random_clusters(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = [int(c) for c in centres]
    for c in centres:
        for _ in range(15):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            points.append(x)
    points = np.unique(np.array(points, np.uint64))
    nodes = spark.createDataFrame([(i, int(np.int64(p.view(np.int64)))) for i, p in enumerate(points)], "node long, fp long").selectExpr("0 AS t", "*")
    links = simhash.near_links(nodes, sample_rows=64, shard_rows=32)
    got = {r.node: r.root for r in components(links).collect()}
    forest = simhash.Forest(len(points))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4)
    forest.link(i, j)
    assert [got.get(k, k) for k in range(len(points))] == forest.root.tolist()


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, 9), (9, 3)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 9: 3}


def test_empty(docs_of):
    assert simhash.near_dedup(docs_of([])).collect() == []
    assert [tuple(r) for r in simhash.near_dedup(docs_of([(4, "a")])).collect()][0][2] == 4


def test_more_fingerprints_find_less_alike_texts(docs_of):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for i in range(120):
        text = rng.choices(words, k=300)
        near = list(text)
        for at in rng.sample(range(300), 3):
            near[at] = "changed"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(near))]
    rows += [(1000, rows[0][1]), (1001, None)]

    def found(tables):
        of = {r.doc_id: r.component_id for r in simhash.near_dedup(docs_of(rows), shingle_words=5, tables=tables).collect()}
        assert of[1000] == 0 and of[1001] == 1001 and all(of[d] in (d, d - 1, 0) for d in of)
        return sum(of[2 * i + 1] == 2 * i for i in range(120)) / 120

    one, many = found(1), found(8)
    assert many > 0.8 > 0.7 > one


def test_rows_without_an_id_link_and_bridge(docs_of):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:400 - k] + [f"new{j}" for j in range(k)]) for k in range(0, 60)]
    prints = [simhash.fingerprint(t, 4) for t in texts]
    far = lambda i, j: (prints[i] ^ prints[j]).bit_count()
    near = next(k for k in range(1, 60) if 0 < far(0, k) <= 4)
    got = {r.doc_id: r.component_id for r in simhash.near_dedup(docs_of([(7, texts[0]), (None, texts[near])])).collect()}
    assert got == {7: 7, None: 7}
    # A text without an id between two that are too far apart for a link of their own.
    i, j, k = next((i, j, k) for i in range(60) for j in range(60) for k in range(60) if far(i, j) > 4 and far(i, k) <= 4 and far(j, k) <= 4)
    rows = [(9, texts[i]), (4, texts[j]), (None, texts[k])]
    assert {(r.doc_id, r.component_id) for r in simhash.near_dedup(docs_of(rows)).collect()} == {(9, 4), (4, 4), (None, 4)}
