import numpy as np
import pytest

from tablesense.llm import plsh
from tablesense.plans.catalog import load

SCHEMA = "vec_id long, embedding array<float>, label int, node string, key string"


def brute(rows, c):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    n = {id(r): 0 for r in rows}
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= c:
                    n[id(a)] += 1
                    n[id(b)] += 1
                    p, q = find(a[0]), find(b[0])
                    root[max(p, q)] = min(p, q)
    return sorted(((r[0], n[id(r)], None if r[0] is None else find(r[0])) for r in rows), key=str)


def run(spark, rows, c):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = plsh.near_vectors(df, c).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def test_odd_vectors_copies_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, [2.0, 4.0, 6.0], 0), (3, v, 0), (3, v, 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0, 0.0], 0),
            (9, [1.0, None, 3.0], 0), (10, [1.0, float("nan"), 3.0], 0), (11, [float("inf"), 2.0, 3.0], 0), (12, [1.0, 2.0], 0), (None, v, 0),
            (13, [-1.0, -2.0, -3.0], 0), (14, [1.0, 2.0, 3.2], 0), (15, [1e30, 2e30, 3e30], 0), (16, [-0.0, 0.0, 1.0], 0), (17, [0.0, 0.0, 2.0], 0)]
    assert run(spark, rows, 0.93) == brute(rows, 0.93)
    assert plsh.near_vectors(spark.createDataFrame([], SCHEMA), 0.93).count() == 0


@pytest.mark.parametrize("noise", [0.02, 0.05, 0.09])
def test_groups_of_near_copies(spark, noise):
    """Balls, members at their rim, and pairs on both sides of the threshold."""
    rng = np.random.default_rng(int(noise * 100))
    rows = []
    for g in range(12):
        base = rng.standard_normal(32)
        base /= np.linalg.norm(base)
        for _ in range(1 + 60 * (g == 0) + 4 * (g % 3)):
            rows.append((len(rows), (base + noise * rng.standard_normal(32) * rng.random()).astype(np.float32).tolist(), g % 2))
    want, got = brute(rows, 0.93), run(spark, rows, 0.93)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))  # no link below the threshold
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert np.mean([g[2] == w[2] for g, w in zip(got, want, strict=True)]) > 0.97


def test_recall_at_the_threshold_itself(spark):
    """Pairs of cosine 0.931: the planned recall holds for the least similar."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (0.931 * a + np.sqrt(1 - 0.931**2) * b).tolist(), 0)]
    got = run(spark, rows, 0.93)
    assert sum(g[1] for g in got) / 800 > 0.92


def test_rates_fall_with_distance_and_plans_reach_the_recall():
    assert plsh.hit_rate(0.1) > plsh.hit_rate(0.4) > plsh.hit_rate(1.4) > 0
    for n in (2, 1000, 10**9):
        t = plsh.plan(0.93, n)
        assert 1 - (1 - plsh.hit_rate(np.sqrt(0.14)) ** t.k) ** t.tables >= plsh.RECALL


def test_recall_on_the_table(spark):
    v = load(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in v.collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in plsh.near_vectors(v, 0.93).collect()), key=str)
    assert got == brute(rows, 0.93)
