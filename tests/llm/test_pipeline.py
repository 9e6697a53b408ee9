import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tallyforge.llm import byte_bpe, quality, simhash
from tallyforge.session import settle


def by_hand(docs, items):
    """The pipeline on (doc_id, text) pairs with unique ids, each stage the plain way; leaks are whole items in a text."""
    kept = [(i, t) for i, t in docs if not (s := quality.Stats(t)).base_failed and not any(rule(s) for rule in quality.RULES.values())]
    seen, cut = set(), []
    for i, t in sorted(kept):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        gone = set()
        for w in zip(at, at[1:], at[2:]):
            key = tuple(lines[k] for k in w)
            gone |= set(w) if key in seen else set()
            seen.add(key)
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or text.split():
            cut.append((i, text))
    fps = {i: set(simhash._hashes(t, cp.SHINGLE_WORDS).tolist()) for i, t in cut}
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if root[i] != root[j] and (fps[i] == fps[j] or 5 * len(fps[i] & fps[j]) >= 4 * len(fps[i] | fps[j])):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    alone = [(i, t) for i, t in cut if root[i] == i]
    clean = [(i, t) for i, t in alone if not any(x.lower().split() == t.lower().split()[k:k + len(x.split())] for x in items for k in range(len(t.split())))]
    encoding = byte_bpe.encoder()[0]
    return sorted((i, len(encoding.encode_ordinary(t))) for i, t in clean)


def made(seed=6):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("rak", "sol", "tin", "vem", "zup", "xid")]
    text = lambda n, per=9: "\n".join(" ".join(rng.choices(words, k=per)) for _ in range(n // per))
    items = [" ".join(rng.choices(words, k=rng.randint(15, 50))) for _ in range(6)]
    docs = [(i, text(rng.randint(60, 300))) for i in range(60)]
    shared = text(45)
    docs += [(100 + i, docs[i][1]) for i in range(8)]                                   # exact copies
    docs += [(120 + i, docs[i][1].replace("\n", " ") + " end") for i in range(8)]       # near copies on one line
    docs += [(140 + i, text(90) + "\n" + shared + "\n" + text(90)) for i in range(8)]   # a shared passage
    docs += [(160 + i, text(90) + " " + items[i % 6] + " " + text(60)) for i in range(9)]
    docs += [(180, "too short"), (181, None), (182, ""), (183, "### " * 80), (184, "same words again " * 60)]
    return docs, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, items = made()
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_equals_plain_version(spark, folder):
    docs, items = made()
    got = sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, folder).collect())
    assert got == by_hand(docs, items)


def test_stages_keep_the_columns_and_take_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(30)
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))) \
        .withColumn("text", F.when(F.col("doc_id") == 5, None).otherwise(F.col("text"))).withColumns({"kept": F.lit("k"), "leaks": F.lit(1), "n_removed": F.lit("r")})
    for name, stage in cp.STAGES[:-1]:
        got = settle(stage(spark, odd, folder))
        assert got.columns == odd.columns and got.dtypes == odd.dtypes, name
        assert got.count() > 0
        empty = stage(spark, odd.limit(0), folder)
        assert empty.columns == odd.columns and empty.count() == 0
        odd = got
    assert cp.encoding_stage(spark, odd, folder).count() == odd.count()
    assert len(cp.STAGES) == 5
