import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from tablesense.llm import variants as V


def vocab(rows, every, least_length=5, least_count=3):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if every:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % every == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least_length and n >= least_count}


def apart(a, b):
    """Edit distance 1, the plain way: every edit of a."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def brute(words):
    near = {w: [x for x in words if apart(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def texts(seed=5):
    r = random.Random(seed)
    stems = ["".join(r.choice("abeno") for _ in range(r.randint(5, 7))) for _ in range(40)] + ["Éclair", "straße", "Nation", "x" * 400]
    rows = []
    for i in range(120):
        ws = [r.choice(stems[:1 + (i * 7) % len(stems)] + stems[-4:]) for _ in range(60)]
        ws += [w[:-1] + r.choice("aex") for w in ws[:8]]
        rows.append((i % 50, " ".join(ws) + " über12straße STRASSE"))
    return [*rows, (None, rows[0][1]), (7, None), (8, "")] + [rows[3]] * 4


@pytest.mark.parametrize("node,asked,every", [(4_000, 100_000, None), (8, 40, 5)])
def test_equals_brute_force(spark, monkeypatch, node, asked, every):
    monkeypatch.setattr(V, "LEAF", 2)
    monkeypatch.setattr(V, "PAIRS", 500)
    monkeypatch.setattr(V, "TABLE_WORDS", 20)
    monkeypatch.setattr(V, "WHOLE", 300)
    rows = texts()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = brute(vocab(rows, every))
    assert len(want) > 40 and sum(w[3] is not None for w in want) > 5
    assert result(V.spelling_variants(df, node=node, asked=asked, drop_every=every)) == want


def test_documents_with_odd_rows(clash):
    rows = [(r.doc_id, r.text) for r in clash.collect()]
    assert result(V.spelling_variants(clash, drop_every=3)) == brute(vocab(rows, 3))


def test_words_of_equal_vectors(spark):
    """Letters of one pair only: every vector is shared by many words."""
    words = {"".join(p): 3 + i for i, p in enumerate(itertools.product("ab", repeat=6))}
    df = spark.createDataFrame([(1, " ".join([w] * n)) for w, n in words.items()], "doc_id long, text string")
    assert result(V.spelling_variants(df, node=10, asked=20)) == brute(words)


def test_long_chain_and_ties(spark):
    chain = {"a" * 5 + "b" * k: 3 * 2 ** (9 - k) for k in range(9)}
    words = {**chain, "katze": 3, "tatze": 8, "matze": 8}
    df = spark.createDataFrame([(1, " ".join([w] * n)) for w, n in words.items()], "doc_id long, text string")
    got = result(V.spelling_variants(df))
    assert got == brute(words)
    assert {r[0]: r[5] for r in got}["aaaaabbbbbbbb"] == "aaaaa" and {r[0]: r[3] for r in got}["katze"] == "matze"


def test_empty_table(documents):
    assert V.spelling_variants(documents.limit(0)).count() == 0
