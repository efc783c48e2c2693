import random
from collections import Counter
from math import exp, log

import numpy as np

from tablesense.llm import langid
from tablesense.plans.catalog import load


def bucket(gram):
    """The hash of an n-gram, in plain integers."""
    h = len(gram)
    for c in gram:
        h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % 2**64
        h ^= h >> 29
    return h % langid.BUCKETS


def brute(rows, texts):
    """Plain multinomial naive Bayes over dictionaries: (language, score) of every text."""
    def grams(t):
        low = (t or "").lower()
        return Counter(bucket(low[i:i + n]) for n in langid.ORDERS for i in range(len(low) - n + 1))
    counts, n = {}, Counter(x for _, x in rows)
    for t, x in rows:
        counts.setdefault(x, Counter()).update(grams(t))
    total = {x: sum(c.values()) + langid.ALPHA * langid.BUCKETS for x, c in counts.items()}
    out = []
    for t in texts:
        if t is None or not any(ch.isalpha() for ch in t):
            out.append(("und", 0.0))
            continue
        g = grams(t)
        s = {x: log(n[x] / len(rows)) + sum(k * log((counts[x][b] + langid.ALPHA) / total[x]) for b, k in g.items()) for x in sorted(counts)}
        best = max(s, key=s.get)
        heat = max(1.0, sum(g.values()) / langid.EVIDENCE)
        out.append((best, 1 / sum(exp((v - s[best]) / heat) for v in s.values())))
    return out


def test_equals_brute_force_on_odd_rows(clash):
    got = langid.identify(clash, langid.train(clash), keep=["doc_id", "text", "node"]).collect()
    rows = [(r.text, r.lang) for r in clash.collect() if r.lang is not None]
    assert len(got) == clash.count()
    for r, want in zip(got, brute(rows, [r.text for r in got]), strict=True):
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-6


def test_plain_argmax_with_rare_languages_and_long_texts(spark):
    """A rare language whose letters are those of the frequent one: every
    prediction is that of plain naive Bayes, at every length."""
    rng = random.Random(4)
    word = {"aa": ["lan", "mor", "tis", "ven", "sol", "rak"], "bb": ["lan", "mor", "tis", "vem", "sel", "rok"]}
    make = lambda x, n: " ".join(rng.choice(word[x]) for _ in range(n))
    rows = [(make("aa", 12), "aa") for _ in range(400)] + [(make("bb", 12), "bb") for _ in range(4)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    tests = [make(x, n) for x in word for n in (1, 3, 20, 60, 400) for _ in range(25)]
    want = brute(rows, tests)
    got = model.scores(tests)
    assert got[0] == [w for w, _ in want] and np.allclose(got[1], [p for _, p in want])
    assert {"aa", "bb"} == set(got[0])


def test_a_long_text_in_pieces(documents, monkeypatch):
    model = langid.train(documents)
    texts = [r.text for r in documents.limit(40).collect()] + ["", None, "a" * 1000, "\u0130x" * 500]
    whole = model.scores(texts)
    monkeypatch.setattr(langid, "CHUNK", 7)
    cut = model.scores(texts)
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1])


def test_no_labels_and_empty_table(documents):
    model = langid.train(documents.limit(0))
    assert {r.lang_pred for r in langid.identify(documents, model).collect()} == {"und"}
    assert langid.identify(documents.limit(0), langid.train(documents)).count() == 0


def test_counts_do_not_depend_on_batches_or_partitions(documents, monkeypatch):
    a = langid.train(documents)
    monkeypatch.setattr(langid, "CHUNK", 10)
    b = langid.train(documents.repartition(5))
    assert a.languages == b.languages and np.allclose(a.matrix, b.matrix) and np.allclose(a.prior, b.prior)


def test_held_out_accuracy(spark):
    from tablesense.llm.common import fold
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    held = fold("doc_id", 4, 2)
    got = langid.identify(docs.where(held), langid.train(docs.where(~held))).where("lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
