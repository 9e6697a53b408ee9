import hashlib
import random

from tallyforge.llm import byte_bpe


def plain(rows):
    encoding, spelled, _ = byte_bpe.encoder()
    out = []
    for doc, text in rows:
        ids = encoding.encode_ordinary(text or "")
        out.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def texts():
    rng = random.Random(5)
    parts = ["a", "word", "don't", "''s", "1", "23", "  ", "\n", "\n\n", " \t ", "é", "日本", "😀", "...", "'ll", "<|endoftext|>", " ", "x" * 40, "\x1c"]
    for n in (0, 1, 5, 40, 300, 900):
        for _ in range(6):
            yield "".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(n))
    yield "z" * 700
    yield " " * 700 + "end"
    yield "日" * 500
    yield "a " * 3000


def test_same_ids_whatever_the_chunks(docs_of):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, None), (None, "q r " * 200), (7, None), (3, "s t " * 100), (3, "s t " * 100)]
    for chunk, overlap in ((64, 16), (200, 50), (32_768, 512)):
        digests = byte_bpe.digests(docs_of(rows, extra=True), chunk_chars=chunk, overlap=overlap)
        assert sorted((tuple(r) for r in digests.collect()), key=str) == plain(rows)


def test_long_texts_are_cut_and_decode_to_their_bytes(docs_of):
    rows = [(1, "some words and more, é日 " * 500), (2, "w" * 5000)]
    encoded = byte_bpe.encode(docs_of(rows), chunk_chars=256, overlap=64)
    got = {}
    for r in sorted(byte_bpe.decode(encoded).collect(), key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).append(bytes(r.data))
    assert {k: b"".join(v).decode() for k, v in got.items()} == dict(rows)
    assert len(got[1]) > 20 and len(got[2]) == 1


def test_empty_table(docs_of):
    assert byte_bpe.digests(docs_of([])).collect() == []
