"""Benchmark decontamination by latent semantic retrieval.

Benchmark items of up to `PART_WORDS` words are one part. Longer ones are cut into parts of `LONG_PART_WORDS`
words that overlap, at most `PART_STEP` words apart, the last at the item's end, so 50 words in a row quoted from anywhere hold
`COPY_SHARE` of some part. Parts are taken in blocks of about `BLOCK_PARTS`, which bounds what the driver or a task
holds: terms (at most `PART_WORDS` a part) times `RANK` numbers. A benchmark of one block takes three maps over the
documents:

1. The document frequency of its words is counted over all documents. A part's vocabulary is its
   words in at most `MAX_DF` of the documents, or its `RAREST` rarest where those are fewer.
2. Passages of `PASSAGE_WORDS` words, half overlapping, become TF-IDF rows over the vocabulary of all parts.
   A randomised SVD of these passages and the parts' own rows finds a latent space of at most `RANK` directions, and fewer
   than terms: rows are multiplied with a random block in tasks, products are summed by blocks of terms, and only a
   matrix of terms times rank reaches the driver. Words that stand in the same passages get like directions.
3. Each passage is projected. Candidates are parts whose projection has a cosine of `MIN_COSINE` with the passage's, and,
   so that no copy depends on an approximation, parts of whose own weight the passage holds `MIN_COVERAGE`,
   whatever else the passage holds. The longest common subsequence of words with a stretch half as long again as
   the part then decides: `copy` from `COPY_SHARE` of the part's words, `paraphrase` from `LIKE_SHARE` if the answer is
   there too. Of the part's vocabulary words alone `LIKE_SHARE` must be there in order, unless the passage is near
   the part in the latent space: then other words of the same subject may stand in their place, and it is a `paraphrase`
   at most. The answer is the item's `answer`, or its last `ANSWER_WORDS` words; for a part of a long item it may be as
   far away as the item is long. A part of fewer than `SHORT_WORDS` words must stand there word by word.

Words outside the vocabulary of all parts have no direction, so a paraphrase in words that no item holds is found by its
literal words alone.

Texts never move. Passages without vocabulary words can't be candidates and add nothing to the SVD, so they aren't
stored.

Words are maximal runs of anything but ASCII punctuation and white space, lower-cased. Null
and empty texts and items match nothing. Ids may be null or repeated; rows are judged one by one. Columns of any
name but `leaks` are kept.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.llm.common import arrow_map, extended, query, table
from tallyforge.session import settle

PART_WORDS = 64
LONG_PART_WORDS = 48
PART_STEP = 16
BLOCK_PARTS = 4096
PASSAGE_WORDS = 64
MAX_DF = 0.01
RAREST = 8
RANK = 64
TERMS_PER_DIRECTION = 8
MIN_COSINE = 0.6
MIN_COVERAGE = 0.35
COPY_SHARE = 0.8
LIKE_SHARE = 0.6
ANSWER_WORDS = 6
SHORT_WORDS = 8

_BREAKS = string.punctuation.encode()
_TABLE = bytes(32 if c in _BREAKS else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


@dataclass
class Part:
    item_id: int | None
    words: list[bytes]
    answer: list[bytes] = field(default_factory=list)
    reach: int = 0  # words around a passage that may hold the answer; 0: the stretch alone

    def answered(self, words: list[bytes], start: int, around: list[bytes]) -> bool:
        """Is half of the answer, in order, near the passage at `start` of `words`?"""
        if not self.answer or not self.reach:
            return 2 * common_subsequence(self.answer, around) >= len(self.answer)
        return closest(self.answer, words[max(0, start - self.reach):start + PASSAGE_WORDS + self.reach])[0] >= 0.5


def parts_of(item_id: int | None, words: list[bytes], told: list[bytes]) -> list[Part]:
    answer = told or words[-ANSWER_WORDS:]
    if len(words) <= PART_WORDS:
        return [Part(item_id, words, answer)] if words else []
    steps = -(-(len(words) - LONG_PART_WORDS) // PART_STEP)
    starts = [k * (len(words) - LONG_PART_WORDS) // steps for k in range(steps + 1)]
    return [Part(item_id, words[s:s + LONG_PART_WORDS], answer, len(words) * 3 // 2 + len(answer)) for s in starts]


def _blocks(benchmark: DataFrame) -> Iterator[list[Part]]:
    """Blocks of about BLOCK_PARTS parts; only one block at a time is on the driver."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where("text IS NOT NULL").select("item_id", "text", answer.alias("answer"))
    n_parts = items.agg(F.coalesce(F.sum(F.ceil(F.char_length("text") / (4 * PART_WORDS))), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(n_parts) // BLOCK_PARTS))
    held = settle(items)
    for k in range(n_blocks):
        parts = []
        for r in held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy("item_id", "text").toLocalIterator():
            for part in parts_of(r.item_id, words_of(r.text), words_of(r.answer)):
                parts.append(part)
                if len(parts) == 2 * BLOCK_PARTS:
                    yield parts
                    parts = []
        if parts:
            yield parts


def _document_frequency(docs: DataFrame, wanted: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """Documents that hold each wanted word, and all documents."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = Counter(), 0
        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(start, 256).to_pylist():
                    total += 1
                    counts.update(wanted.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array([b"", *counts], pa.binary()), "n": pa.array([total, *counts.values()], pa.int64())})

    rows = docs.select("text").transform(arrow_map, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r.word): r.n for r in rows}
    return found, found.pop(b"", 0)


def _vocabulary(parts: list[Part], frequency: dict[bytes, int], total: int) -> dict[bytes, float]:
    """Inverse document frequency of the words that stand for the parts."""
    chosen: dict[bytes, float] = {}
    for part in parts:
        ranked = sorted(set(part.words), key=lambda w: (frequency.get(w, 0), w))
        rare = [w for w in ranked if frequency.get(w, 0) <= MAX_DF * total]
        for w in rare if len(rare) >= RAREST else ranked[:RAREST]:
            chosen[w] = float(np.log((total + 1) / (frequency.get(w, 0) + 1)) + 0.1)
    return chosen


def spans(words: list[bytes], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The half-overlapping passages that hold a term: first words, where the terms of each begin, and their distinct terms."""
    ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
    hits = np.flatnonzero(ids >= 0)
    half = PASSAGE_WORDS // 2
    last = max(0, (len(words) - 1) // half - 1)
    block, term = hits // half, ids[hits]
    own, before = block <= last, block >= 1
    width = len(number)
    keys = np.unique(np.concatenate([block[own] * width + term[own], (block[before] - 1) * width + term[before]]))
    passage, terms = np.divmod(keys, max(1, width))
    firsts = np.flatnonzero(np.diff(passage, prepend=-1))
    return passage[firsts] * half, firsts, terms


def windows(words: list[bytes], number: dict[bytes, int]) -> Iterator[tuple[int, list[int]]]:
    """(first word, distinct terms) of every half-overlapping passage that holds a term."""
    starts, firsts, terms = spans(words, number)
    for start, found in zip(starts.tolist(), np.split(terms, firsts[1:])):
        yield start, found.tolist()


def passages(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """The terms of every passage of every document, one row each."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 1024):
                found = [spans(words_of(text), number)[1:] for text in batch.column(0).slice(start, 1024).to_pylist()]
                sizes = np.concatenate([np.diff(firsts, append=len(terms)) for firsts, terms in found])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                                 pa.array(np.concatenate([terms for _, terms in found]), pa.int32()))
                yield pa.RecordBatch.from_pydict({"terms": lists})

    return docs.select("text").transform(arrow_map, run, "terms array<int>")


_TERMS = 256  # terms in a block of a product


def _add_gram(terms: np.ndarray, sizes: np.ndarray, weighted: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A w) to `out`, but for the weights on the left; A has a row of `sizes` terms for each list in `terms`."""
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    products = np.add.reduceat(weighted[terms], firsts, axis=0)
    order = np.argsort(terms, kind="stable")
    owner = np.repeat(np.arange(len(sizes)), sizes)[order]
    which, at = np.unique(terms[order], return_index=True)
    out[which] += np.add.reduceat(products[owner], at, axis=0)


def _times_gram(rows: DataFrame, weights: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A'A times `block` for the TF-IDF rows A that `rows` stands for."""
    weighted = (weights[:, None] * block).astype(np.float32)
    shape = weighted.shape

    def multiply(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape, np.float64)
        for batch in stream:
            for start in range(0, batch.num_rows, 2048):
                lists = batch.column(0).slice(start, 2048)
                _add_gram(lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False), weighted, out)
        out *= weights[:, None]
        starts = range(0, shape[0], _TERMS)
        yield pa.RecordBatch.from_pydict({"part": pa.array([s // _TERMS for s in starts], pa.int32()),
                                          "data": pa.array([out[s:s + _TERMS].tobytes() for s in starts], pa.binary())})

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, None
        for batch in group:
            for number, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                own = np.frombuffer(data.as_buffer(), np.float64)
                part, total = number, own.copy() if total is None else total + own
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    summed = rows.transform(arrow_map, multiply, "part int, data binary").groupBy("part").applyInArrow(add, "part int, data binary")
    out = np.zeros(shape)
    for r in summed.toLocalIterator():
        own = np.frombuffer(bytes(r.data), np.float64).reshape(-1, shape[1])
        out[r.part * _TERMS:r.part * _TERMS + len(own)] = own
    return out


def latent_basis(rows: DataFrame, weights: np.ndarray, own: list[np.ndarray], rank: int, power: int = 1) -> np.ndarray:
    """Orthonormal basis (terms x rank) of the leading right singular space of the passages and, counting as much as
    all of them together, the parts, whose terms `own` lists."""
    rng = np.random.default_rng(11)
    block = np.linalg.qr(rng.standard_normal((len(weights), min(rank, len(weights)))))[0]
    terms, sizes = np.concatenate(own), np.array([len(x) for x in own])
    for _ in range(power + 1):
        product, parts = _times_gram(rows, weights, block), np.zeros_like(block)
        _add_gram(terms, sizes, weights[:, None] * block, parts)
        parts *= weights[:, None]
        block = np.linalg.qr(product + max(1.0, np.abs(product).sum() / np.abs(parts).sum()) * parts)[0]
    return block


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits of one whole number per word of `a`."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return (full & ~row).bit_count()


def closest(part: list[bytes], around: list[bytes]) -> tuple[float, list[bytes]]:
    """Largest share of `part` that is a common subsequence with a stretch of `around` half as long again, and that stretch."""
    size, step = len(part) * 3 // 2 + 4, max(1, len(part) // 4)
    best = (-1, around)
    for start in range(0, max(1, len(around) - size + step), step):
        stretch = around[start:start + size]
        best = max(best, (common_subsequence(part, stretch), stretch), key=lambda x: x[0])
    return best[0] / len(part), best[1]


_PASSAGES = 4096  # passages of one text that are compared with all parts at a time


@dataclass
class Index:
    """What a task needs of one block: terms, the parts that hold each, and the projections of terms and parts."""

    number: dict[bytes, int]
    energy: np.ndarray  # squared weight of each term
    holders: np.ndarray  # parts, those of a term one after the other
    held: np.ndarray  # where a term's parts begin, and the end
    norms: np.ndarray  # squared weight of each part
    projected: np.ndarray  # terms x rank, with their weights
    latent: np.ndarray  # parts x rank, of unit length
    parts: list[Part]

    @classmethod
    def of(cls, parts: list[Part], number: dict[bytes, int], weights: np.ndarray, basis: np.ndarray) -> Index:
        own = part_terms(parts, number)
        terms, sizes = np.concatenate(own), np.array([len(x) for x in own])
        firsts = np.cumsum(sizes) - sizes
        order = np.argsort(terms, kind="stable")
        projected = (weights[:, None] * basis).astype(np.float32)
        latent = np.add.reduceat(projected[terms], firsts, axis=0)
        return cls(number, weights ** 2, np.repeat(np.arange(len(own)), sizes)[order], np.searchsorted(terms[order], np.arange(len(weights) + 1)),
                   np.add.reduceat(weights[terms] ** 2, firsts), projected,
                   latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9), parts)

    def candidates(self, firsts: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, part, latent cosine) of what is near in the latent space, or holds enough of the part itself."""
        sizes = np.diff(firsts, append=len(terms))
        live = np.flatnonzero(np.add.reduceat(self.energy[terms], firsts) >= MIN_COVERAGE * self.norms.min())
        for chunk in np.split(live, range(_PASSAGES, len(live), _PASSAGES)):
            if not len(chunk):
                continue
            width, n = len(self.parts), sizes[chunk]
            first = np.cumsum(n) - n
            own = terms[np.repeat(firsts[chunk] - first, n) + np.arange(n.sum())]
            z = np.add.reduceat(self.projected[own], first, axis=0)
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
            near = z @ self.latent.T
            count = self.held[own + 1] - self.held[own]
            part = self.holders[np.repeat(self.held[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            keys, place = np.unique(np.repeat(np.repeat(np.arange(len(chunk)), n), count) * width + part, return_inverse=True)
            share = np.bincount(place, np.repeat(self.energy[own], count)) / self.norms[keys % width]
            for key in np.union1d(keys[share >= MIN_COVERAGE - 1e-9], np.flatnonzero(near >= MIN_COSINE)).tolist():
                yield int(chunk[key // width]), key % width, float(near.flat[key])

    def leaks(self, text: str | None) -> list[dict]:
        words = words_of(text)
        starts, firsts, terms = spans(words, self.number)
        best: dict[int | None, dict] = {}
        for passage, k, cosine in self.candidates(firsts, terms) if len(starts) else ():
            part, start = self.parts[k], int(starts[passage])
            around = words[max(0, start - PASSAGE_WORDS // 2):start + PASSAGE_WORDS * 3 // 2]
            there = set(around)
            if sum(w in there for w in part.words) < LIKE_SHARE * len(part.words):
                continue
            share, around = closest(part.words, around)
            kind = self._kind(part, share, cosine, words, start, around)
            if kind and share > best.get(part.item_id, {"lcs": 0.0})["lcs"]:
                best[part.item_id] = {"item_id": part.item_id, "kind": kind, "lcs": share, "cosine": max(-1.0, min(1.0, cosine))}
        return list(best.values())

    def _kind(self, part: Part, share: float, cosine: float, words: list[bytes], start: int, around: list[bytes]) -> str | None:
        if len(part.words) < SHORT_WORDS:
            return "copy" if share == 1 and _inside(part.words, around) else None
        if share < LIKE_SHARE:
            return None
        rare = [w for w in part.words if w in self.number]
        literal = common_subsequence(rare, [w for w in around if w in self.number]) >= LIKE_SHARE * len(rare)
        if literal and share >= COPY_SHARE:
            return "copy"
        return "paraphrase" if (literal or cosine >= MIN_COSINE) and part.answered(words, start, around) else None


def _inside(a: list[bytes], b: list[bytes]) -> bool:
    return any(b[i:i + len(a)] == a for i in range(len(b) - len(a) + 1))


def part_terms(parts: list[Part], number: dict[bytes, int]) -> list[np.ndarray]:
    """The distinct terms of each part; every part has one, since its rarest words are terms."""
    return [np.array(sorted({number[w] for w in p.words if w in number}), np.int64) for p in parts]


def fit_block(docs: DataFrame, parts: list[Part]) -> Index:
    frequency, total = _document_frequency(docs, frozenset(w for p in parts for w in p.words))
    idf = _vocabulary(parts, frequency, total)
    number = {w: i for i, w in enumerate(sorted(idf))}
    weights = np.array([idf[w] for w in sorted(idf)])
    rank = min(RANK, max(2, len(weights) // TERMS_PER_DIRECTION))
    return Index.of(parts, number, weights, latent_basis(settle(passages(docs, number)), weights, part_terms(parts, number), rank))


def with_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with `leaks`, the benchmark items found in each text (replaced if there): item_id, kind, lcs, cosine."""
    kind = "array<struct<item_id:long,kind:string,lcs:double,cosine:double>>"
    docs = docs.drop("leaks")
    out = docs.withColumn("leaks", F.array().cast(kind))
    for parts in _blocks(benchmark):
        index = fit_block(docs, parts)
        at = out.columns.index("text")

        def run(stream: Iterator[pa.RecordBatch], index: Index = index, at: int = at) -> Iterator[pa.RecordBatch]:
            typ = pa.list_(pa.struct([("item_id", pa.int64()), ("kind", pa.string()), ("lcs", pa.float64()), ("cosine", pa.float64())]))
            for batch in stream:
                found = [index.leaks(t) for s in range(0, batch.num_rows, 256) for t in batch.column(at).slice(s, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, typ)], names=[*batch.schema.names, "_more"])

        out = out.transform(arrow_map, run, extended(out.schema, f"_more {kind}")).withColumn("leaks", _merged("leaks", "_more")).drop("_more")
    return out


def _merged(a: str, b: str) -> Column:
    """The leaks of both columns, an item that is in both (its parts were in two blocks) once."""
    def other(x: Column, y: Column) -> Column:
        return x["item_id"].eqNullSafe(y["item_id"])

    kept = F.filter(a, lambda x: ~F.exists(b, lambda y: other(x, y) & (y["lcs"] > x["lcs"])))
    return F.concat(kept, F.filter(b, lambda y: ~F.exists(a, lambda x: other(x, y) & (x["lcs"] >= y["lcs"]))))


@query("op7_decontamination")
def op7_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.kind", F.round("leak.lcs", 6).alias("lcs"), F.round("leak.cosine", 4).alias("cosine"))
