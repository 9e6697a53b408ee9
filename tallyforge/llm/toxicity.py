"""Toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause as a string of word classes: insult, threat, target, negation,
reported speech, other. Three small transducers pass hits on with what surrounds them: whether a
negation reaches them, whether they are reported speech, whether they are aimed at someone. Their
composition is one deterministic transducer, built once; each hit leaves it as one of sixteen
matched patterns. A weight per pattern, learned by logistic regression on the logarithm of the
counts, gives the score, so that "he said you are no idiot" isn't scored as "you idiot" is.

Closed classes (targets, negations, verbs of saying, threats) are word lists in four languages.
Insults differ between corpora and inflect, so their stems are learned: word beginnings and whole
words that labelled toxic texts hold significantly more often than clean ones. Lexicon and weights
are fitted on at most `max_rows` labelled rows picked by a hash of the id, so both are bounded and
may be sent to every task. Ids, languages and sources are never looked at by a score.

Null texts are empty; an empty text gets the score of the bias. Where the labels are all alike or there
are none, every score is their smoothed share of toxic ones. Null labels don't count as labels.
Rows with a null id are scored and never learned from. Repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import arrow_map, extended, query, table
from tallyforge.session import settle

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
_BREAK = frozenset(".!?;\n")
CLOSED = {
    "target": "you your yours yourself he him she her they them their these those people du dich dir ihr euch sie er tu te toi vous il elle ils elles tú ti te usted ustedes él ella ellos",
    "negation": "not no never none nobody nothing without isn aren wasn don doesn didn nicht kein keine keinen nie niemals ohne ne pas jamais rien sans nunca jamás sin nada",
    "report": "said says say called calls claimed claims wrote writes quoted quote told reported according sagte sagt nannte schrieb behauptet laut dit appelle appelé écrit selon dijo dice llamó escribió según",
    "threat": "kill hurt destroy beat burn shoot stab murder hang punish töten umbringen schlagen zerstören tuer frapper brûler détruire matar golpear quemar destruir",
}
_CLASS = {w: name for name, words in CLOSED.items() for w in words.split()}
_PREFIXES = (4, 5, 6, 7)

# A transducer maps (state, symbol) to (state, symbol); a missing entry keeps the symbol and takes the state's default.
SCOPE, REACH = 3, 5
_FLAGS = ("negated", "reported", "aimed")


@dataclass(frozen=True)
class Transducer:
    """Deterministic: `step(state, symbol)` gives the next state and the symbol passed on. Symbols are (class, flags)."""

    start: int
    opener: str
    flag: int
    scope: int | None  # tokens that an opener reaches; None: to the end of the clause

    def step(self, state: int, symbol: tuple[str, frozenset]) -> tuple[int, tuple[str, frozenset]]:
        kind, flags = symbol
        if kind == self.opener:
            return (1 if self.scope is None else self.scope), symbol
        if state and kind in ("insult", "threat"):
            symbol = (kind, flags | {self.flag})
        return (state if self.scope is None else max(0, state - 1)), symbol


def compose(parts: list[Transducer], alphabet: list[str]) -> tuple[list[list[int]], list[list[int]]]:
    """The composition as tables over states and classes: next state, and the pattern put out (-1: none)."""
    states = {tuple(p.start for p in parts): 0}
    todo, following, output = [tuple(p.start for p in parts)], [], []
    while todo:
        now = todo.pop(0)
        row, out = [], []
        for kind in alphabet:
            symbol, after = (kind, frozenset()), []
            for part, state in zip(parts, now):
                state, symbol = part.step(state, symbol)
                after.append(state)
            key = tuple(after)
            if key not in states:
                states[key] = len(states)
                todo.append(key)
            row.append(states[key])
            out.append(-1 if kind not in ("insult", "threat") else 8 * (kind == "threat") + sum(1 << f for f in symbol[1]))
        following.append(row)
        output.append(out)
    return following, output


ALPHABET = ["other", "insult", "threat", "target", "negation", "report"]
_NUMBER = {name: i for i, name in enumerate(ALPHABET)}
GRAMMAR = compose([Transducer(0, "negation", 0, SCOPE), Transducer(0, "report", 1, None), Transducer(0, "target", 2, REACH)], ALPHABET)
PATTERNS = [f"{kind}:{'+'.join(n for i, n in enumerate(_FLAGS) if m >> i & 1) or 'plain'}" for kind in ("insult", "threat") for m in range(8)]


class Lexicon:
    """Insults: whole words and beginnings of words."""

    def __init__(self, entries: list[str]):
        self.words = frozenset(e[:-1] for e in entries if e.endswith("$"))
        self.stems = tuple((n, frozenset(e for e in entries if len(e) == n and not e.endswith("$"))) for n in _PREFIXES)
        self.heads = frozenset(e.rstrip("$")[:4] for e in entries) | frozenset(w[:4] for w in CLOSED["threat"].split())

    def kind(self, word: str) -> int:
        if word in self.words or any(word[:n] in found for n, found in self.stems):
            return 1
        return _NUMBER[_CLASS.get(word, "other")]


def patterns(text: str | None, lexicon: Lexicon) -> list[int]:
    """How often each pattern of the grammar matches in `text`."""
    counts = [0] * 16
    tokens = _TOKEN.findall((text or "").lower())
    heads = lexicon.heads
    at = [i for i, w in enumerate(tokens) if w[:4] in heads and lexicon.kind(w) in (1, 2)]
    following, output = GRAMMAR
    read = -1
    for hit in at:
        if hit <= read:
            continue
        start = hit
        while start > 0 and tokens[start - 1] not in _BREAK:
            start -= 1
        state, read = 0, start
        while read < len(tokens) and tokens[read] not in _BREAK:
            kind = lexicon.kind(tokens[read])
            if (pattern := output[state][kind]) >= 0:
                counts[pattern] += 1
            state = following[state][kind]
            read += 1
    return counts


def beginnings(text: str | None) -> set[str]:
    """Whole words (marked `$`) and word beginnings of a text, each once."""
    words = {w for w in _TOKEN.findall((text or "").lower()) if w not in _BREAK}
    return {f"{w}$" for w in words} | {w[:n] for w in words for n in _PREFIXES if len(w) >= n}


def learn_lexicon(train: DataFrame, max_entries: int = 2000) -> list[str]:
    """Insults of `train` (text, toxic): beginnings whose excess in toxic texts is beyond what the number of candidates explains.

    Texts per beginning are counted in tasks, then summed; only significant ones, at most `max_entries`, come to the driver.
    """

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dirty, clean = Counter(), Counter()

        def out():
            keys = list(dirty.keys() | clean.keys())
            return pa.RecordBatch.from_pydict({"entry": pa.array(keys, pa.string()), "dirty": pa.array([dirty[k] for k in keys], pa.int64()),
                                               "clean": pa.array([clean[k] for k in keys], pa.int64())})

        for batch in stream:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                (dirty if toxic else clean).update(beginnings(text))
                if len(dirty) + len(clean) > 400_000:
                    yield out()
                    dirty.clear(), clean.clear()
        yield out()

    totals = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not 0 < totals.t < totals.n:
        return []
    share = totals.t / totals.n
    summed = (train.select("text", "toxic").transform(arrow_map, count, "entry string, dirty long, clean long")
              .groupBy("entry").agg(F.sum("dirty").alias("dirty"), F.sum("clean").alias("clean")).where("dirty >= 3"))
    n = F.col("dirty") + F.col("clean")
    excess = 2 * (F.col("dirty") * F.log(F.col("dirty") / (n * share))
                  + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - share)))).otherwise(0.0))
    scored = settle(summed.withColumn("excess", F.round(excess, 9)))
    limit = 2 * math.log(max(10, scored.count())) + 2
    best = (scored.where((F.col("excess") > limit) & (F.col("dirty") > 3 * share / (1 - share) * F.col("clean")))
            .orderBy(F.desc("excess"), F.desc(F.length("entry")), "entry").limit(4 * max_entries).collect())
    chosen: dict[str, int] = {}
    for r in best:
        bare = r.entry.rstrip("$")
        covered = any(bare.startswith(c) for c in chosen if not c.endswith("$"))
        if not covered and not any(c.startswith(bare) and n == r.dirty for c, n in chosen.items()):  # same texts, less specific
            chosen[r.entry] = r.dirty
    return list(chosen)[:max_entries]


@dataclass
class Model:
    entries: list[str]
    bias: float
    weights: list[float]

    def score(self, counts: list[int]) -> float:
        z = self.bias + sum(w * math.log1p(c) for w, c in zip(self.weights, counts) if c)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _counted(docs: DataFrame, entries: list[str]) -> DataFrame:
    at = docs.columns.index("text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for batch in stream:
            found = [patterns(t, lexicon) for s in range(0, batch.num_rows, 256) for t in batch.column(at).slice(s, 256).to_pylist()]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found, pa.list_(pa.int32()))], names=[*names, "counts"])

    return docs.transform(arrow_map, run, extended(docs.drop("text").schema, "counts array<int>"))


def fit(train: DataFrame, penalty: float = 0.1) -> Model:
    """Lexicon and weights from `train` (text, toxic 0/1), which the caller has bounded."""
    entries = learn_lexicon(train)
    # Equal counts are one row with a number of texts, so few rows come to the driver.
    rows = _counted(train.select("text", "toxic"), entries).groupBy("counts", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy("counts", "toxic").collect()
    if len({r.toxic for r in rows}) < 2:
        share = sum(r.n * r.toxic for r in rows) / max(1, sum(r.n for r in rows))
        return Model(entries, math.log((share + 1e-3) / (1 - share + 1e-3)), [0.0] * 16)
    x = np.column_stack([np.ones(len(rows)), np.log1p(np.array([r.counts for r in rows], float))])
    y, n = np.array([r.toxic for r in rows], float), np.array([r.n for r in rows], float)
    ridge, w = np.diag([1e-6] + [penalty] * 16), np.zeros(17)
    for _ in range(60):  # Newton's steps, halved where they overshoot
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w = w + step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return Model(entries, float(w[0]), [float(v) for v in w[1:]])


def bounded_training(docs: DataFrame, labels: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """text and toxic of at most about `max_rows` labelled documents whose id isn't held out, picked by a hash of the id."""
    usable = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("doc_id"))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = max(1, -(-usable.count() // max_rows))
    picked = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    # Bounded by `max_rows`; without the hint every text would move.
    return settle(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic"))


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without its text, with score and the pattern counts (columns of these names are replaced)."""
    docs = docs.drop("score", "counts")
    weights = F.array(*[F.lit(w) for w in model.weights])
    z = F.aggregate(F.zip_with("counts", weights, lambda c, w: F.log1p(c.cast("double")) * w), F.lit(model.bias), lambda a, v: a + v)
    return _counted(docs, model.entries).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(bounded_training(docs, table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
