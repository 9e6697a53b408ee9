import random
import zlib

from tallyforge.llm import toxicity as tox


def test_grammar_marks_context():
    lexicon = tox.Lexicon(["idiot$", "stup"])
    of = lambda text: {tox.PATTERNS[i]: n for i, n in enumerate(tox.patterns(text, lexicon)) if n}
    assert of("what an idiot") == {"insult:plain": 1}
    assert of("you stupid idiot") == {"insult:aimed": 2}
    assert of("this is not stupid") == {"insult:negated": 1}
    assert of("he said they are no idiot") == {"insult:negated+reported+aimed": 1}
    assert of("she said hello. idiot") == {"insult:plain": 1}
    assert of("not one of those people is an idiot") == {"insult:aimed": 1}
    assert of("I will kill you") == {"threat:plain": 1} and of("you we kill") == {"threat:aimed": 1}
    assert of(None) == of("") == of("idiots stu") == {}


def test_composition_equals_the_chain():
    parts = [tox.Transducer(0, "negation", 0, 3), tox.Transducer(0, "report", 1, None), tox.Transducer(0, "target", 2, 5)]
    following, output = tox.compose(parts, tox.ALPHABET)
    rng = random.Random(1)
    for _ in range(200):
        state, states = 0, [0, 0, 0]
        for kind in rng.choices(tox.ALPHABET, k=30):
            symbol = (kind, frozenset())
            for i, part in enumerate(parts):
                states[i], symbol = part.step(states[i], symbol)
            want = 8 * (kind == "threat") + sum(1 << f for f in symbol[1]) if kind in ("insult", "threat") else -1
            at = tox.ALPHABET.index(kind)
            assert output[state][at] == want
            state = following[state][at]


def made(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "te") for b in ("ra", "su", "ne") for c in ("do", "pa", "zi")]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 60))
        toxic = i % 6 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["grumbold", "grumbolda", "snarf"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_unseen_labels(spark, docs_of):
    rows, labels = made(1500, 4)
    rows += [(None, "grumbold"), (None, None), (9001, ""), (9002, "grumbolds and more"), (0, rows[0][1])]
    docs = docs_of(rows, extra=True)
    labelled = spark.createDataFrame(labels + [(9003, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = tox.fit(tox.bounded_training(docs, labelled))
    assert any("grumbold".startswith(e.rstrip("$")) for e in model.entries)
    scored = tox.score_toxicity(docs.select("doc_id", "text", "score"), model).select("doc_id", tox.held_out("doc_id").alias("h"), "score").collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    truth = {i: t for i, _, t in labels}
    tested = [r for r in scored if r.h and r.doc_id in truth]
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in tested) / len(tested) > 0.97
    # Labels of held-out rows don't matter.
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = tox.fit(tox.bounded_training(docs, flipped))
    assert again == model


def test_no_labels_and_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tox.fit(tox.bounded_training(docs_of([(1, "a")]), none))
    assert {round(r.score, 6) for r in tox.score_toxicity(docs_of([(1, "a"), (2, None)]), model).collect()} == {0.000998}
    assert tox.score_toxicity(docs_of([]), model).collect() == []
