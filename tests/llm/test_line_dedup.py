import random
import time

from tallyforge.llm.line_dedup import line_dedup

RNG = random.Random(31)


def plain(rows, width=3):
    seen, out = {}, []
    whole = {i: t for i, t in rows if i is not None and t is not None}
    places = []
    for i, t in sorted(whole.items()):
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        for w in zip(*(at[k:] for k in range(width))):
            key = tuple(lines[k] for k in w)
            if seen.setdefault(key, (i, w)) != (i, w):
                places.append((i, w))
    gone = {i: set() for i in whole}
    for i, w in places:
        gone[i] |= set(w)
    for i, t in rows:
        cut = gone.get(i, set()) if t is not None else set()
        lines = (t or "").split("\n")
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in cut) if t is not None else None, len(lines) if t is not None else 0, len(cut)))
    return sorted(out, key=str)


def test_equals_plain_removal(docs_of):
    lines = [f"line {i}" for i in range(12)] + ["", " ", "\t"]
    rows = [(i, "\n".join(RNG.choices(lines, k=RNG.randint(0, 25)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a\nb"), (103, "a\nb\nc"), (104, "a\nb\nc"), (105, "x\n\na\n \nb\nc"), (None, "a\nb\nc"), (None, "a\nb\nc"),
             (106, "\n".join(["same"] * 3000)), (107, "a\nb\nc\r"), (103, "a\nb\nc")]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup(docs_of(rows, extra=True).drop("n_removed")).collect()), key=str)
    assert got == plain(rows)


def test_passages_shared_by_documents_stay_once(docs_of):
    passage = "\n".join(f"shared sentence number {k} of the passage" for k in range(9))
    rows = [(i, f"own {i} first\nown {i} second\n{passage}\nown {i} last") for i in range(40)]
    got = {r.doc_id: r.text for r in line_dedup(docs_of(rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own {i} first\nown {i} second\nown {i} last" for i in range(1, 40))


def test_other_columns_and_empty_tables(docs_of):
    df = docs_of([(1, "a")], extra=True)
    got = line_dedup(df)
    assert set(df.columns) <= set(got.columns) and got.columns.count("n_lines") == 1
    assert line_dedup(docs_of([])).collect() == []


def test_time_follows_the_lines_of_a_long_text(spark, docs_of):
    def seconds(n):
        text = "\n".join(f"line {i}" for i in range(n))
        start = time.perf_counter()
        rows = line_dedup(docs_of([(1, text), (2, text), (3, "\n".join([text, "own", "lines", "here"]))])).collect()
        took = time.perf_counter() - start
        assert {r.doc_id: (r.n_lines, r.n_removed) for r in rows} == {1: (n, 0), 2: (n, n), 3: (n + 3, n)}
        assert {r.doc_id: r.text for r in rows} == {1: text, 2: "", 3: "own\nlines\nhere"}
        return took

    seconds(1000)
    short = min(seconds(40_000) for _ in range(2))
    assert min(seconds(80_000) for _ in range(2)) < 2.2 * short
