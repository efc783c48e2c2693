import numpy as np

from tablesense.llm import fm
from tablesense.llm.common import fold
from tablesense.plans.catalog import load


def test_terms_split_case_and_beginnings():
    assert set(fm.terms("Idiot, idiot!")) == set(fm.terms("IDIOT idiot")) == set(fm.terms("idiot"))
    assert len(fm.terms("abc")) == 1 and len(fm.terms("abcde")) == 2 and len(fm.terms("abcdefg")) == 3
    assert not len(fm.terms(None)) and not len(fm.terms(" .,! "))
    assert len(np.intersect1d(fm.terms("loweiabc"), fm.terms("loweixyz"))) == 1  # the first 4 bytes; 6 differ
    assert len(fm.terms("a" * 100)) == 3 and set(fm.terms("a" * 100)) != set(fm.terms("a" * 99))


def test_learns_pairs_that_additive_weights_miss():
    """Toxic only if exactly both or neither of two words are there."""
    rng = np.random.default_rng(1)
    texts, y = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        texts.append(" ".join(["zork"] * a + ["blim"] * b + [f"w{rng.integers(0, 30)}"]))
        y.append(float(a == b))
    rows = [fm.terms(t) for t in texts]
    pick = np.unique(np.concatenate(rows))
    old, fm.pick = fm.pick, lambda *_: pick  # neither word alone tells anything
    try:
        f, w0, w, v = fm.fit(np.array(y), rows)
    finally:
        fm.pick = old
    place = np.full(1 << fm.BITS, -1)
    place[f] = np.arange(len(f))
    full, linear = fm.Model(place, w0, w, v), fm.Model(place, w0, w, np.zeros_like(v))
    right = lambda m: np.mean([(m.score(t) > 0.5) == (x == 1) for t, x in zip(texts[:500], y, strict=False)])
    assert right(full) > 0.95 and right(linear) < 0.8


def test_score_is_the_formula_of_all_pairs():
    rng = np.random.default_rng(2)
    t = fm.terms("some words to score here")
    place = np.full(1 << fm.BITS, -1)
    place[t[:-1]] = np.arange(len(t) - 1)
    w, v = rng.normal(size=len(t) - 1), rng.normal(size=(len(t) - 1, 3))
    f = 0.3 + w.sum() + sum(v[i] @ v[j] for i in range(len(w)) for j in range(i))
    assert abs(fm.Model(place, 0.3, w, v).score("score here some words to") - 1 / (1 + np.exp(-f))) < 1e-12


def test_odd_rows_single_class_and_empty_tables(spark, clash):
    lab = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (8, 0), (None, 1), (5, None), (99, 1)], "id long, toxic int")
    got = fm.score(clash, fm.train(clash, lab), keep=["doc_id", "text"]).collect()
    assert len(got) == clash.count() and all(0 <= r.score <= 1 for r in got)
    blank = {round(r.score, 12) for r in got if r.text is None or not len(fm.terms(r.text))}
    assert len(blank) == 1
    for rows, want in (([(1, 0)], 0.0), ([(1, 1)], 1.0), ([], 0.0)):
        model = fm.train(clash, spark.createDataFrame(rows, "id long, toxic int"))
        assert {r.score for r in fm.score(clash, model).collect()} <= {want} or want in (0.0, 1.0) and all(abs(r.score - want) < 1e-9 for r in fm.score(clash, model).collect())
    assert fm.score(clash.limit(0), fm.train(clash, lab)).count() == 0


def test_held_out_accuracy(spark):
    docs, lab = (load(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    held = fold("doc_id", 3, 1)
    model = fm.train(docs, lab.where(~held).selectExpr("doc_id AS id", "toxic"))
    got = fm.score(docs.join(lab.where(held), "doc_id"), model, keep=["doc_id", "toxic"]).collect()
    # About one toxic label in seven of this table stands on a text that shows no
    # sign of it (measured: 21 of 144 held out), so the recall can't reach 0.9.
    hit = [r.score >= 0.7 for r in got if r.toxic == 1]
    false = [r.score >= 0.7 for r in got if r.toxic == 0]
    assert np.mean(hit) > 0.8 and np.mean(false) < 0.01


def test_same_model_in_every_run(spark):
    docs, lab = (load(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    lab = lab.selectExpr("doc_id AS id", "toxic")
    a, b = fm.train(docs, lab), fm.train(docs.repartition(7), lab.repartition(3))
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v) and np.array_equal(a.place, b.place)
