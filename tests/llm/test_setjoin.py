import time
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesense.llm import setjoin as S
from tablesense.llm.components import connected_components
from tablesense.plans.catalog import load


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


class Union(dict):
    def root(self, i):
        while self.setdefault(i, i) != i:
            i = self[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def brute(rows, k, p, q):
    """(doc_id -> class, sizes) by comparing sets that share a shingle."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    by, u = defaultdict(list), Union()
    for n, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                by[x].append(n)
    seen = set()
    for ns in by.values():
        for a, b in combinations(ns, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                x, y = sets[a][1], sets[b][1]
                if q * len(x & y) >= p * len(x | y):
                    u.join(sets[a][0], sets[b][0])
    return sorted(((i, len(s), None if i is None else u.root(i)) for i, s in sets), key=str)


def run(df, k, p, q):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in S.jaccard_join(df, k, p, q).collect()), key=str)


@pytest.mark.parametrize("p,sizes,n", [(90, [1, 2, 3, 8, 10, 12, 20], 150), (80, [1, 3, 4, 5, 8, 20, 40], 150), (80, [60, 150], 90),
                                       (90, [100, 300], 60), (50, [3, 8, 20], 80)])
@pytest.mark.parametrize("count", [1, 10**9])
def test_index_meets_every_similar_pair(p, sizes, n, count):
    """Whatever plan the costs choose (few or very many sets per band)."""
    rng = np.random.default_rng(p + n)
    edges = S.limits(p, 100, 2 * max(sizes))
    plan = S.Plan(p, 100, tuple(S.Band(lo, *S.allocate(lo, -(-lo * 3 // 2) + 1, count, p, 100)) for lo in edges))
    sets = []
    while len(sets) < n:
        base = np.unique(rng.integers(0, 2**63, rng.choice(sizes)).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        sets.append(base)
        for _ in range(5):
            near = base[rng.random(len(base)) > rng.uniform(0, 1.2 - p / 100)]
            near = np.unique(np.concatenate([near, rng.integers(0, 2**63, rng.integers(0, max(2, len(base) // 6))).astype(np.uint64)]))
            if len(near):
                sets.append(near)
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for band, role in plan.of(len(s)):
            for key, r in zip(*(x.tolist() for x in S.index_rows(s, band, role, plan)), strict=True):
                index[key].append((i, r))
    met = {(min(i, j), max(i, j)) for v in index.values() for (i, a), (j, b) in combinations(v, 2) if not a & b}
    for i, j in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= p * (len(sets[i]) + len(sets[j]) - both):
            assert (i, j) in met


def test_sets_that_run_out_of_segments_still_meet():
    plan = S.Plan(80, 100, (S.Band(1, 3, 0),))  # every shingle in one segment
    a = np.arange(1, 9, dtype=np.uint64)
    b = a[:-1]
    (ka, ra), (kb, rb) = (S.index_rows(x, 0, 0, plan) for x in (a, b))
    assert set(ka.tolist()) & set(kb.tolist())


def test_shingles_follow_ascii_white_space_and_case():
    s = S.Shingler(3)
    same = lambda a, b: np.array_equal(s(a), s(b))
    assert same("A b\tC\x0bd\r\ne", "a B c D E") and not same("a b c", "a c b") and not same("é b c", "É b c")
    assert not same("a b c", "ab c") and not same("a b", "b a") and len(s("a")) == 1 and len(s("a b c d")) == 2
    assert not len(s(None)) and not len(s(" \n")) and not same("a　b c d", "a b c d") and len(s("x " * 5000)) == 1


def test_odd_rows_clashing_columns_and_empty_table(clash):
    rows = [(r.doc_id, r.text) for r in clash.collect()]
    for k, p in ((3, 90), (5, 80)):
        assert run(clash, k, p, 100) == brute(rows, k, p, 100)
    assert S.jaccard_join(clash.limit(0), 3, 90, 100).count() == 0


@pytest.mark.parametrize("k,p", [(3, 90), (5, 80), (2, 50)])
def test_equals_brute_force_on_near_copies(spark, k, p):
    """Chains, a large group of near copies of one text, shared passages."""
    rng = np.random.default_rng(k)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    passage, rows, base = word(40), [], word(60)
    for i in range(150):
        t = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            t[at] = f"n{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(t)))
    for i in range(150, 220):
        rows.append((i, " ".join(word(10) + passage + word(int(rng.integers(1, 30))))))
    t = word(50)
    for i in range(220, 260):  # each a little further from the first
        t = t[1:] + word(1)
        rows.append((i, " ".join(t)))
    rows += [(i, " ".join(word(int(rng.integers(1, 12))))) for i in range(260, 300)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), k, p, 100) == brute(rows, k, p, 100)


def test_equals_brute_force_on_the_corpus(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run(docs, 5, 80, 100) == brute(rows, 5, 80, 100)


def test_components_of_stars_chains_and_cycles(spark):
    rng = np.random.default_rng(4)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 40)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    pairs += [tuple(int(x) for x in rng.integers(400, 460, 2)) for _ in range(45)]
    u = Union()
    for a, b in pairs:
        if a is not None and a != b:
            u.join(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: u.root(i) for i in list(u)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def met(rng, n, gone):
    """One label of n sets that share most shingles: node, own component, set."""
    base = np.unique(rng.integers(0, 2**63, 120).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > gone], rng.integers(0, 2**63, 2).astype(np.uint64)])) for _ in range(n)]
    return [(i + 1, s) for i, s in enumerate(sets)]


def test_near_group_gives_a_tree_not_all_its_pairs(spark):
    sets = met(np.random.default_rng(1), 60, 0.02)
    rows = spark.createDataFrame([("x", 0, i, 0, i, len(s), S.sketch(s, 128).tobytes()) for i, s in sets],
                                 "label string, side int, node long, role tinyint, g long, n long, sketch binary")
    got = S.near_by_sketch(rows, 80, 100).collect()
    pairs, rest = [r for r in got if r.label is None], [r for r in got if r.label is not None]
    assert len(pairs) == 59 and len(rest) == 60 and len({r.b for r in rest}) == 1


@pytest.mark.parametrize("gone", [0.05, 0.1, 0.12, 0.2])
def test_whole_sets_connect_what_all_links_would(spark, gone):
    """Many pairs just above and below the limit, a few members linked already."""
    sets = met(np.random.default_rng(int(gone * 100)), 70, gone)
    g = {i: 1 if i % 9 == 0 else i for i, _ in sets}
    rows = spark.createDataFrame([(f"x{i % 2}", i, g[i], s.tobytes()) for i, s in sets], "label string, node long, g long, shingles binary")
    size, want, have = dict(sets), Union(), Union()
    for i, c in g.items():
        for u in (want, have):
            u.join(i, c)
    for i, j in combinations(size, 2):
        both = len(np.intersect1d(size[i], size[j]))
        if i % 2 == j % 2 and 100 * both >= 80 * (len(size[i]) + len(size[j]) - both):
            want.join(i, j)
    links = S.exact_links(rows, 80, 100).collect()
    for r in links:
        have.join(r.a, r.b)
    assert len(links) < len(sets) and [have.root(i) for i in size] == [want.root(i) for i in size]


def test_written_frees_its_shuffles_and_discard_its_files(spark):
    import glob
    import os

    from tablesense.llm.common import discard, written
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = {str(b) for b in local.getAllFiles().mkString("|").split("|")}
    out = written(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    for _ in range(50):  # files go in the background
        left = {f for f in local.getAllFiles().mkString("|").split("|") if "shuffle_" in f} - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and out.count() == 7 and glob.glob(f"{out.written_to}/*.parquet")
    discard(out)
    assert not os.path.exists(out.written_to)
