import re

from tallyforge.llm import licenses

RULES = licenses.rules()


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    joined = " " + " ".join(words) + " "
    base, hits = [], []
    for phrase, label in licenses.BASE:
        n = len(phrase.split())
        base += [(i, label) for i in range(len(words)) if " ".join(words[i:i + n]) == phrase]
    for number, (label, _, pattern, priority, weight) in enumerate(RULES):
        for m in re.finditer(f"(?= ({pattern}) )", joined):
            start = joined[:m.start()].count(" ")
            hits.append((start, -(start + len(m[1].split(" "))), -priority, number, label, weight))
    reach, kept = -1, []
    for start, stop, _, number, label, weight in sorted(hits):
        if -stop > reach:
            reach = -stop
            kept.append((start, -stop - 1, number, label, weight))
    return len(words), sorted(i for i, _ in base), sorted({x for _, x in base}), kept


TEXTS = [
    None, "", " \n", "Released under the MIT License.", "under the mit license under the MIT-license", "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0. cc by nc cc_by_nc", "This work is licensed under the GNU General Public License, version 3.", "ich gehe mit dem Hund, mit Lizenz",
    "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: BSD-3-Clause OR 0BSD", "CC-BY-SA 4.0 and cc by nc nd 3.0", "é MIT Licence Ünder the mit license",
    "GPLv3 gpl GPL 2.0 agpl", "mitlicense occur accept", "All rights reserved " * 300, "word " * 3000 + "apache license version 2 " * 50 + "x " * 500,
    "public domain; dedicated to the public domain", "distributed under the terms of the Mozilla Public License, v. 2.0", "\x00MIT\x7flicense\x00",
]


def test_equals_plain_search(docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (3, TEXTS[3])]
    got = sorted(((r.doc_id, r.n_words, sorted(r.base_starts), sorted(set(r.base_labels)), [tuple(d) for d in r.detections])
                  for r in licenses.scan(docs_of(rows, extra=True)).collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=str)


def test_longer_names_suppress_shorter_ones(docs_of):
    labels = {r.doc_id: [d.label for d in r.detections] for r in licenses.scan(docs_of(list(enumerate(TEXTS)))).collect()}
    assert labels[3] == ["mit"] and labels[6][0] == "cc-by-nc" and labels[7] == ["gpl-3"] and labels[8] == [] and labels[9] == ["mit"]
    assert labels[11] == ["cc-by-sa", "cc-by-nc-nd"] and labels[14] == []


def test_rules_are_many_and_gated():
    assert len(RULES) > 300
    gate = re.compile("(?i)" + "|".join(licenses.gate_words(RULES)))
    assert all(gate.search(t) for t in TEXTS if plain(t)[3])


def test_empty_table(docs_of):
    assert licenses.scan(docs_of([])).collect() == []
