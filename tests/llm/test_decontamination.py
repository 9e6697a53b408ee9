import random
from functools import cache

import numpy as np

from tallyforge.llm import decontamination as d

RNG = random.Random(8)
COMMON = [f"c{i}" for i in range(30)]
RARE = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("rak", "sol", "tin", "vem", "zup", "xid")]


def some(n, share=0.3):
    return [RNG.choice(RARE) if RNG.random() < share else RNG.choice(COMMON) for _ in range(n)]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_common_subsequence():
    def plain(a, b):
        @cache
        def go(i, j):
            return 0 if i == len(a) or j == len(b) else 1 + go(i + 1, j + 1) if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

        return go(0, 0)

    for _ in range(60):
        a, b = (tuple(RNG.choices([b"a", b"b", b"c"], k=RNG.randint(0, 25))) for _ in range(2))
        assert d.common_subsequence(list(a), list(b)) == plain(a, b)


def test_windows_cover_every_hit():
    words = [b"x"] * 500
    for i in (0, 1, 31, 32, 63, 64, 200, 499):
        words[i] = b"hit"
    spans = list(d.windows(words, {b"hit": 0}))
    assert all(any(s <= i < s + d.PASSAGE_WORDS for s, _ in spans) for i, w in enumerate(words) if w == b"hit")
    starts = [s for s, _ in spans]
    assert starts == [s for s in range(0, 481, 32) if b"hit" in words[s:s + 64] and s <= 448]


def test_gram_product_and_basis(spark):
    rng = np.random.default_rng(1)
    lists = [sorted(rng.choice(40, rng.integers(1, 8), replace=False).tolist()) for _ in range(300)]
    weights, block = rng.random(40) + 0.5, rng.standard_normal((40, 6))
    rows = spark.createDataFrame([(x,) for x in lists], "terms array<int>")
    a = np.zeros((300, 40))
    for i, x in enumerate(lists):
        a[i, x] = weights[x]
    assert np.allclose(d._times_gram(rows, weights, block), a.T @ (a @ block), rtol=1e-4, atol=1e-2)
    own = [np.array(sorted(rng.choice(40, 6, replace=False))) for _ in range(5)]
    basis = d.latent_basis(rows, weights, own, 12)
    assert np.allclose(basis.T @ basis, np.eye(12), atol=1e-8)
    # The basis holds nearly as much of the rows and the parts, which weigh as much as all rows, as the best one of its rank.
    parts = np.zeros((5, 40))
    for k, x in enumerate(own):
        parts[k, x] = weights[x]
    both = np.vstack([a, parts * np.linalg.norm(a) / np.linalg.norm(parts)])
    best = np.linalg.svd(both, compute_uv=False)[:12]
    assert (np.linalg.norm(both @ basis) ** 2) > 0.95 * (best ** 2).sum()


def test_planted_leaks(spark, docs_of):
    items = [(i, " ".join(some(RNG.randint(14, 60)))) for i in range(40)] + [(90, " ".join(some(150))), (91, None), (92, ""), (93, "b a"), (None, " ".join(some(30)))]
    rows, want = [], set()
    for i in range(400):
        text = some(RNG.randint(5, 400), 0.05)
        if i % 5 == 0:
            item, words = RNG.choice(items[:40])
            words = words.split()
            if i % 3 == 1:  # paraphrase: one word in six is another
                words = [RNG.choice(COMMON) if k % 6 == 2 and k < len(words) - 7 else w for k, w in enumerate(words)]
            if i % 3 == 2:
                words = " ".join(words).upper().replace(" ", ", ").split(" ")
            at = RNG.randint(0, len(text))
            text[at:at] = words
            want.add((i, item))
        rows.append((i, " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, items[40][1]), (1003, items[44][1]), (None, items[0][1]), (0, rows[0][1]), (1004, " ".join(some(60_000, 0.02)) + " " + items[1][1])]
    want |= {(1002, 90), (1003, None), (None, 0), (1004, 1)}
    got = d.with_leaks(docs_of(rows, extra=True), bench(spark, items)).collect()
    assert len(got) == len(rows) and "score" in got[0].asDict()
    assert {(r.doc_id, x.item_id) for r in got for x in r.leaks} == want


def test_blocks_and_empty_tables(spark, docs_of, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_PARTS", 4)
    items = [(i, " ".join(some(20))) for i in range(15)]
    rows = [(i, " ".join(some(30, 0.02)) + " " + t) for i, t in items]
    got = d.with_leaks(docs_of(rows), bench(spark, items)).collect()
    assert {(r.doc_id, x.item_id) for r in got for x in r.leaks} == {(i, i) for i in range(15)}
    assert [r.leaks for r in d.with_leaks(docs_of(rows[:2]), bench(spark, [])).collect()] == [[], []]
    assert d.with_leaks(docs_of([]), bench(spark, items[:3])).collect() == []


def test_long_items_are_cut_into_even_overlapping_parts():
    for n in (1, 7, 64, 65, 66, 71, 113, 150, 1000):
        words = [b"%d" % i for i in range(n)]
        parts = d.parts_of(1, words, [])
        assert {len(p.words) for p in parts} == {n if n <= d.PART_WORDS else d.LONG_PART_WORDS}
        assert parts[0].words[0] == words[0] and parts[-1].words[-1] == words[-1]
        assert all(p.answer == words[-d.ANSWER_WORDS:] for p in parts)
        for at in range(n - 50 if n > 64 else 0):
            quote = set(words[at:at + 50])
            assert max(len(quote.intersection(p.words)) for p in parts) >= d.COPY_SHARE * d.LONG_PART_WORDS


def test_long_items_leak_by_their_passages_only(spark, docs_of):
    rng = random.Random(5)
    own = [f"{a}{b}" for a in RARE[:60] for b in ("an", "or", "is", "ul")]
    item = rng.sample(own, 130) + ["lonely"]
    short = rng.sample(own, 64) + ["tail"]
    common = lambda n: rng.choices(COMMON, k=n)
    swapped = [w if k % 10 < 7 else "c1" for k, w in enumerate(item[:100])]
    rows = [
        (1, common(70) + ["tail"] + common(70)),        # only the word after the first 64
        (2, common(40) + item[39:89] + common(40)),     # 50 words across the middle
        (3, common(40) + swapped + common(40)),         # reworded, without the answer
        (4, common(40) + swapped + item[100:] + common(40)),
        (5, common(90)),
    ]
    rows += [(10 + i, common(60)) for i in range(400)]
    got = d.with_leaks(docs_of([(i, " ".join(t)) for i, t in rows]), bench(spark, [(7, " ".join(item)), (8, " ".join(short))])).collect()
    assert {(r.doc_id, x.item_id) for r in got for x in r.leaks} == {(2, 7), (4, 7)}


def test_item_in_two_blocks_is_one_leak(spark, docs_of, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_PARTS", 2)
    item = " ".join(random.Random(6).sample(RARE, 200))
    got = d.with_leaks(docs_of([(1, item), (2, "c1 c2 c3")]), bench(spark, [(3, item)])).collect()
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in got} == {1: [3], 2: []}


def plain_leaks(text, index, basis, weights):
    """Every passage against every part, by dense rows."""
    words, found = d.words_of(text), {}
    half = d.PASSAGE_WORDS // 2
    rows = np.zeros((len(index.parts), len(weights)))
    for k, p in enumerate(index.parts):
        for w in p.words:
            if w in index.number:
                rows[k, index.number[w]] = weights[index.number[w]]
    for k in range(max(0, (len(words) - 1) // half - 1) + 1 if words else 0):
        x = np.zeros(len(weights))
        for w in words[k * half:k * half + d.PASSAGE_WORDS]:
            if w in index.number:
                x[index.number[w]] = weights[index.number[w]]
        for part, row in zip(index.parts, rows):
            u, v = x @ basis, row @ basis
            cosine = u @ v / max(1e-9, np.linalg.norm(u) * np.linalg.norm(v))
            if cosine < d.MIN_COSINE and ((x > 0) * row) @ row < d.MIN_COVERAGE * row @ row:
                continue
            share, around = d.closest(part.words, words[max(0, k * half - half):k * half + 3 * half])
            rare = [w for w in part.words if w in index.number]
            same = d.common_subsequence(rare, [w for w in around if w in index.number]) >= d.LIKE_SHARE * len(rare)
            if len(part.words) < d.SHORT_WORDS:
                kind = "copy" if b" ".join(part.words) in b" ".join(around) and share == 1 else None
            elif same and share >= d.COPY_SHARE:
                kind = "copy"
            elif share >= d.LIKE_SHARE and (same or cosine >= d.MIN_COSINE) and part.answered(words, k * half, around):
                kind = "paraphrase"
            else:
                kind = None
            if kind and share > found.get(part.item_id, (None, 0))[1]:
                found[part.item_id] = (kind, share)
    return found


def subject_table():
    """Documents on twelve subjects whose words stand for each other, items on them, and items with every rare word another."""
    rng = random.Random(21)
    subjects = [[f"{a}{x}{i}" for i in range(16)] for a in "klmnpr" for x in ("ol", "um")]
    common = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1500):
        words = rng.choices(common, k=140)
        if i % 10 == 0:
            words[30:60] = rng.choices(subjects[i // 10 % 12], k=30)
        rows.append((i, " ".join(words)))
    items, changed = [], []
    for i in range(60):
        subject, frame = subjects[i % 12], rng.choices(common, k=40)
        places = rng.sample(range(32), 10)
        a, b = list(frame), list(frame)
        for p in places:
            a[p], b[p] = rng.sample(subject, 2)
        items.append((i, " ".join(a)))
        changed.append((5000 + i, " ".join(rng.choices(common, k=20) + b + rng.choices(common, k=20))))
    return rows, items, changed


def test_other_words_of_the_subject_are_found_by_the_latent_space_alone(spark, docs_of):
    rows, items, changed = subject_table()
    table = docs_of(rows + changed)
    parts = [p for i, t in items for p in d.parts_of(i, d.words_of(t), [])]
    index = d.fit_block(table, parts)
    found = {(i, x["item_id"]) for i, t in changed for x in index.leaks(t)}
    want = {(5000 + i, i) for i in range(60)}
    assert len(found & want) >= 54 and not found - want
    assert not any(index.leaks(t) for _, t in rows)
    weights = np.sqrt(index.energy)
    literal = d.Index.of(parts, index.number, weights, np.eye(len(weights)))
    assert len({(i, x["item_id"]) for i, t in changed for x in literal.leaks(t)} & want) <= 30
    # The query's rows are those of dense rows, passage by passage.
    basis = index.projected / weights[:, None]
    got = {r.doc_id: {x.item_id: (x.kind, x.lcs) for x in r.leaks} for r in d.with_leaks(table, bench(spark, items)).collect()}
    for i, t in changed + rows[:200]:
        assert got[i] == plain_leaks(t, index, basis, weights), i


def test_items_one_after_the_other_are_all_found(spark, docs_of):
    rng = random.Random(9)
    items = [(i, " ".join(some(rng.randint(4, 29), 0.6))) for i in range(60)]
    rows = [(1, " ".join(t for _, t in items))] + [(10 + i, " ".join(some(100, 0.02))) for i in range(300)]
    got = d.with_leaks(docs_of(rows), bench(spark, items)).where("doc_id = 1").first()
    assert {x.item_id for x in got.leaks} == set(range(60))
