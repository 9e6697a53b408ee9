import random
import re
from collections import Counter

from tallyforge.llm import quality as q

RNG = random.Random(21)
GAPS = [" ", " ", " ", "  ", "\n", "\n", "\t", "\x0b", "\r\n", "\x85", "\xa0"]
WORDS = ["a", "bb", "é", "日本", "x*y", "#", "the", "word", "$5", "<b>", "ok.", "\x1c", "100"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeat, dup = len(covered), sum(x in lines[:i] for i, x in enumerate(lines))
    symbols, chars = len(re.findall(r"[#*$%&|<>]", text)), sum(map(len, words))
    base = len(words) < 50 or 100 * repeat > 50 * len(words)
    rejected = (base or 10 * symbols > len(words) or 10 * dup > 6 * len(lines) or not 2 * len(words) <= chars <= 20 * len(words)
                or 10 * sum(bool(re.search(r"[^\W\d_]", w)) for w in words) < 6 * len(words)
                or 100 * len(re.findall("[\x00-\x08\x0e-\x1f\x7f�]", text)) > chars
                or 10 * sum(bool(re.match(r"\s*(- |\* |•)", x)) for x in lines) > 9 * len(lines)
                or 10 * sum(bool(re.search(r"(\.\.\.|…)\s*$", x)) for x in lines) > 3 * len(lines))
    return len(words), chars, symbols, dup, repeat, base, not rejected


def texts():
    for n in (0, 1, 3, 4, 49, 50, 60, 200, 2000):
        for share in (1, 2, 4, 13):
            yield "".join(RNG.choice(WORDS[-share:]) + RNG.choice(GAPS) for _ in range(n))
    fine = [f"word{i}" for i in range(80)]
    yield " ".join(fine)
    yield "\n".join("- " + w for w in fine)
    yield "\n".join(w + " ..." for w in fine)
    yield " ".join(fine) + "\n" + "\n".join(["same line"] * 40)
    yield " ".join(fine) + " \x01\x02�" * 10
    yield " ".join(w + "*" for w in fine)
    yield "w" * 30_000 + " " + " ".join(fine)
    yield from (None, "", " \n\t")


def test_equals_plain_statistics(docs_of):
    rows = list(enumerate(texts())) + [(None, " ".join(f"w{i}" for i in range(70)))]
    rows += [rows[5], rows[5]]
    got = sorted((tuple(r) for r in q.quality_cascade(docs_of(rows, extra=True)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=str)
    assert {True, False} == {r[-1] for r in got}


def test_order_changes_no_verdict(docs_of):
    docs = docs_of(list(enumerate(texts())))
    order = q.rule_order(docs, sample_rows=10)
    assert sorted(order) == sorted(q.RULES)
    verdicts = [{r.doc_id: r.kept for r in q.quality_cascade(docs, o).collect()} for o in (order, order[::-1])]
    assert verdicts[0] == verdicts[1]


def test_empty(docs_of):
    assert q.quality_cascade(docs_of([])).collect() == []
