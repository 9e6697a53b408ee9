import random
from fractions import Fraction

from tallyforge.llm import attribution as at
from tallyforge.llm.byte_bpe import encoder

RNG = random.Random(12)
PARTS = ["a", "word ", "é", "日本", "😀", "\n", "\n\n\n", "  ", "don't", "\n \n", "x" * 30, " the", "\r\n", ".\n"]


def plain(text, spans):
    encoding = encoder()[0]
    tokens, place = [], 0
    for i in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(i))
        tokens.append((place, place + size))
        place += size
    spans = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in spans]
    start, major, share, cross = [0] * len(spans), [0] * len(spans), [Fraction(0)] * len(spans), [0] * len(spans)
    for a, b in tokens:
        held = [max(0, min(b, d) - max(a, c)) for c, d in spans]
        for k, (c, d) in enumerate(spans):
            start[k] += c <= a < d
            share[k] += Fraction(held[k], b - a)
            cross[k] += 0 < held[k] < b - a
        if any(held):
            major[held.index(max(held))] += 1
    return [(s, m, round(float(f), 6), c) for s, m, f, c in zip(start, major, share, cross)]


def lines(text):
    spans, place = [], 0
    for x in text.split("\n"):
        spans.append((place, place + len(x) + 1))
        place += len(x) + 1
    spans[-1] = (spans[-1][0], len(text))
    return spans


def test_lines(docs_of):
    texts = [None, "", "\n", "\n\n\n\n", "one line", " ".join(["long"] * 40_000)] + ["".join(RNG.choices(PARTS, k=RNG.randint(1, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb"), (3, texts[3])]
    got = {}
    for r in at.attribute(docs_of(rows, extra=True)).collect():
        got.setdefault(r.doc_id, {}).setdefault(r.section, []).append((r.start_char, r.end_char, r.tokens_start, r.tokens_majority, round(r.tokens_fraction, 6), r.crossing))
    for i, t in rows:
        spans = lines(t or "")
        copies = 2 if i == 3 else 1
        assert got[i] == {k: [(*s, *v)] * copies for k, (s, v) in enumerate(zip(spans, plain(t or "", spans)))}


def test_rules_add_up_to_the_whole(docs_of):
    text = "".join(RNG.choices(PARTS, k=400))
    rows = at.attribute(docs_of([(1, text)])).collect()
    n = len(encoder()[0].encode_ordinary(text))
    assert sum(r.tokens_start for r in rows) == sum(r.tokens_majority for r in rows) == n and abs(sum(r.tokens_fraction for r in rows) - n) < 1e-6


def test_named_fields(spark):
    text = "Title of it|body text 日本 here|😀"
    spans = [("title", 0, 11), ("body", 12, 30), (None, 31, 99), ("none", 5, 3), ("gap", 11, 12), ("inside", 13, 14)]
    df = spark.createDataFrame([(1, text, spans), (2, None, spans), (3, "x", None)], "doc_id long, text string, parts array<struct<name:string,start:long,end:long>>")
    got = sorted((tuple(r) for r in at.attribute(df, "parts").where("doc_id = 1").collect()), key=lambda r: r[1])
    cut = [(a, max(a, min(b, len(text)))) for _, a, b in spans]
    want = plain(text, cut)
    assert [(r[2], (r[3], r[4]), r[5], round(r[7], 6), r[8]) for r in got] == [(n, c, w[0], w[2], w[3]) for (n, _, _), c, w in zip(spans, cut, want)]
    assert at.attribute(df, "parts").where("doc_id = 2").agg({"tokens_start": "sum"}).first()[0] == 0
    assert at.attribute(df, "parts").where("doc_id = 3").count() == 0


def test_empty(docs_of):
    assert at.attribute(docs_of([])).collect() == []
