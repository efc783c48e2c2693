import random

from tablesense.llm import patience as P
from tablesense.plans.catalog import load


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_longest_increasing_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        x = rng.sample(range(50), rng.randrange(12))
        got = P.increasing(x)
        assert got == sorted(got) and [x[i] for i in got] == sorted(x[i] for i in got)
        best = max((bin(m).count("1") for m in range(1 << len(x))
                    if (s := [x[i] for i in range(len(x)) if m >> i & 1]) == sorted(s)), default=0) if len(x) < 11 else len(got)
        assert len(got) == best


def test_alignment_is_a_common_subsequence_and_near_the_longest():
    rng = random.Random(2)
    for _ in range(300):
        b = [rng.randrange(30) for _ in range(25)]
        a = [x for x in b if rng.random() > 0.1]
        a = [rng.randrange(30) for _ in range(5)] + a
        got = P.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        assert len(got) <= lcs(a, b)
    words = list(range(100))
    assert len(P.align([1000, *words, 1001], words)) == 100  # unique words: exact
    assert P.align([], [1]) == [] and P.align([1], []) == []


def test_finds_changed_repeated_and_several_notices():
    s = P.Scanner(P.TEMPLATES)
    grant = P.TEMPLATES["MIT-grant"]
    noisy = " ".join(w for i, w in enumerate(grant.split()) if i % 9)  # 11 % of the words gone
    m = s.scan("the and of " * 400 + noisy.upper() + " to the under " * 400)
    assert [x[0] for x in m] == ["MIT-grant"] and m[0][1] >= 0.8 and m[0][2] == 1200
    twice = s.scan("Released under the MIT License.\nReleased under the MIT License. x Licensed under CC BY-NC 4.0")
    assert [(x[0], x[2]) for x in twice if x[0] == "MIT"] == [("MIT", 0), ("MIT", 5)]
    assert "CC-BY-NC-4.0" in {x[0] for x in twice}
    assert s.scan("released " + "x " * 50 + "under the mit license") == [("MIT", 0.8, 51, 54)]
    assert s.scan("under the license released with mit") == [] and s.scan(None) == [] and s.scan("") == []


def test_bound_never_hides_a_match():
    """Every window of a text, aligned without any bound."""
    rng = random.Random(5)
    t = P.words(P.TEMPLATES["GPL-3.0"])
    s = P.Scanner({"g": P.TEMPLATES["GPL-3.0"]})
    for _ in range(60):
        body = [w for w in t if rng.random() > 0.12]
        text = [rng.choice(t + [b"x", b"y", b"z"] * 4) for _ in range(30)] + body + [b"q"] * rng.randrange(4)
        full = any(len(P.align(text[i:i + len(t)], t)) >= s.needed["g"] for i in range(len(text)))
        assert not full or s.scan(b" ".join(text).decode())


def test_frame_odd_rows_and_empty_table(clash):
    got = P.scan_licenses(clash).collect()
    assert len(got) == clash.count() and all(r.license is None and r.matches == [] for r in got)
    assert P.scan_licenses(clash.limit(0)).count() == 0


def test_all_notice_lines_of_the_corpus_are_found(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    for r in P.scan_licenses(docs, keep=["doc_id", "text"]).collect():
        names = {m.license for m in r.matches}
        for line, name in (("Released under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
                           ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
                           ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0")):
            assert (line in r.text) == (name in names)


def test_siblings_are_told_apart_and_other_licenses_named():
    s = P.Scanner(P.TEMPLATES)
    for text, name in (("Released under the BSD License", "BSD"), ("Released under the ISC License.", "ISC"), ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"),
                       ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"), ("Licensed under CC BY 3.0", "CC-BY-3.0"),
                       ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
                       ("This work is licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"),
                       ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0-notice"),
                       ("x SPDX-License-Identifier: MIT-0", "MIT-0-spdx"), ("Licensed under CC0 1.0", "CC0-1.0"), ("Released under the Unlicense", "Unlicense")):
        assert [m[0] for m in s.scan(text)] == [name], text
    for text in ("Licensed under CC BY-XX 4.0", "Released under the Foo License", "Licensed under the Educational Community License, Version 2.0",
                 "This work is licensed under the GNU General Public License, version 7"):
        assert s.scan(text) == [], text
    for name, t in P.TEMPLATES.items():  # every template finds itself, first
        got = s.scan("some words before " + t + " and after")
        assert got[0][:2] == (name, 1.0) or got[0][1] == 1.0 and len(P.words(P.TEMPLATES[got[0][0]])) >= len(P.words(t)), (name, got)
        assert (name, 1.0) in [m[:2] for m in got]
    three = P.TEMPLATES["BSD-3-Clause-numbered"]
    assert s.scan(three)[0][0] == "BSD-3-Clause-numbered" and "BSD-2-Clause-body" not in {m[0] for m in s.scan(three)}
    assert set(P.REQUIRED) <= set(P.TEMPLATES)
