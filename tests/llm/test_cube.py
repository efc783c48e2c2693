import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesense.llm import common, cube, queries
from tablesense.llm.common import word_count
from tablesense.plans.catalog import load


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 700])
def test_flight_keeps_both_sums_and_leaves_two(n):
    rng = np.random.default_rng(n)
    size, pi = rng.integers(0, 900, n), rng.random(n)
    got = cube.flight(pi, size, rng)
    assert ((got > 0) & (got < 1)).sum() <= 2
    assert got.sum() == pytest.approx(pi.sum(), abs=1e-6) and (got * size).sum() == pytest.approx((pi * size).sum(), abs=1e-3)


def test_landing_comes_near_and_decides_all():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 60, 400):
        size, pi = np.exp(rng.normal(5, 1, n)).astype(int), np.full(n, 0.37)
        got = cube.settle(pi, size, rng)
        assert set(got) <= {0.0, 1.0}
        assert abs((got * size).sum() - (pi * size).sum()) <= size.max()
        if n == 400:
            assert abs((got * size).sum() - (pi * size).sum()) < 0.01 * (pi * size).sum() and abs(got.sum() - pi.sum()) < 3
    for same in (np.zeros(7), np.full(9, 5.0)):
        assert set(cube.settle(np.full(len(same), 0.5), same, rng)) <= {0.0, 1.0}


def test_inclusion_probabilities_hold():
    rng = np.random.default_rng(5)
    size = np.array([5, 80, 7, 300, 45, 45, 9, 120])
    pi = np.array([0.2, 0.5, 0.9, 0.4, 0.3, 0.7, 0.1, 0.6])
    for f in (lambda p, s: cube.settle(p, s, rng), lambda p, s: cube.settle(cube.flight(p, s, rng), s, rng)):
        mean = np.mean([f(pi.copy(), size) for _ in range(4000)], axis=0)
        assert np.abs(mean - pi).max() < 0.035


def targets(sizes, weights, share, most):
    """Water filling by hand; sizes in the order of sources."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    budget, full = share * sum(sizes), [False] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if not full[i]]
        rest = budget - sum(most * s for s, f in zip(sizes, full, strict=True) if f)
        level = rest / sum(w[i] for i in free) if free else 0
        over = [i for i in free if w[i] * level > most * sizes[i]]
        if not over:
            return [most * s if f else x * level for s, x, f in zip(sizes, w, full, strict=True)]
        for i in over:
            full[i] = True


def check(got, rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(len((r.text or "").encode().split()))
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    want = dict(zip(names, targets([sum(by[s]) for s in names], (5, 2, 1), 1.5, 2.0), strict=True))
    assert len(got) == len(rows)
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r.size == len((r.text or "").encode().split()) and r.source_size == sum(by[r.source])
        assert r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    return {s: (taken[s], want[s], max(by[s])) for s in names}


def test_odd_rows_clashing_columns_and_empty_table(clash):
    out = cube.mix_sources(clash)
    for t, want, most in check(out.collect(), clash.collect()).values():
        assert abs(t - want) <= 2 * most
    assert "clash" not in {out.first().copies, out.first().size}
    assert cube.mix_sources(clash.limit(0)).count() == 0


def test_takes_come_near_targets_and_reruns_agree(spark, monkeypatch):
    docs = load(spark, "/root/testdata/sf0.1", "documents")
    got = cube.mix_sources(docs).collect()
    for t, want, _ in check(got, docs.collect()).values():
        assert abs(t - want) < 0.02 * want
    again = cube.mix_sources(docs.repartition(13)).select("doc_id", "copies").collect()
    assert sorted(again) == sorted((r.doc_id, r.copies) for r in got)


def test_blocks_and_levels(spark, monkeypatch):
    """Small blocks force several levels; targets are still met."""
    monkeypatch.setattr(cube, "BLOCK", 40)
    monkeypatch.setattr(cube, "SPARE", 4)
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), "abc"[min(2, int(rng.exponential(0.7)))]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for t, want, _ in check(cube.mix_sources(df).collect(), df.collect()).values():
        assert abs(t - want) < 0.02 * want


def test_word_count_holds_no_words(spark):
    """Equal to regexp_count, without an array of a text's words."""
    ends = ["", " ", "\t", "\n", "\x0b", "\x0c", "\r", " \r\n ", "\x00", "\x1c", "\x85", "\xa0", "　", "$1", "\\"]
    texts = [None, *ends, *[f"{a}w{b}über \U0001f642{c}" for a in ends for b in ends for c in ends], "\n" * 5000 + "x" + " " * 5000, "a b\n" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", word_count(F.col("text")).alias("n"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("want"))
    assert [(r.text, r.n) for r in df.collect()] == [(r.text, r.want) for r in df.collect()]
    assert "regexp_extract_all" not in df.select("n")._jdf.queryExecution().toString()


def test_files_stay_few_at_many_partitions(spark, tmp_dir, monkeypatch):
    """Narrow tables are written in fewer files than there are partitions for
    texts: each file costs an executor processes of its own (chmod)."""
    spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', CAST(id % 50 AS INT))").alias("text"),
                             F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("source")).write.parquet(f"{tmp_dir}/documents.parquet")
    files = []

    def counting(df, name):
        out = common.written(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(cube, "written", counting)
    keys = {"spark.sql.shuffle.partitions": "160", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        out = queries.op7_source_mix(spark, tmp_dir)
        out.write.parquet(f"{tmp_dir}/out")
        files.append(len(spark.read.parquet(f"{tmp_dir}/out").inputFiles()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(files) <= 160 // common.NARROW
    check = spark.read.parquet(f"{tmp_dir}/out").groupBy(F.col("doc_id") % 20).agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert len(check) == 20 and all(abs(r.taken - r.target) <= 2 * r.most for r in check)
