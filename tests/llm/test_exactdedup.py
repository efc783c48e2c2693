import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tablesense.llm import exactdedup
from tablesense.session import scratch_path


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def assert_same(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        t = r.text or ""
        assert (r.keep_id, r.group_size) == want[t]
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert not r.kept or r.doc_id == r.keep_id
        kept[t] += r.kept
    assert all(n == 1 for n in kept.values()) and len(kept) == len(want)


def test_groups_ties_nulls_and_clashing_columns(clash):
    assert_same(exactdedup.exact_dedup(clash).collect(), clash.collect())


def test_equal_digests_of_different_texts_stay_apart(documents):
    weak = lambda t: F.length(t).cast("string").cast("binary")
    assert_same(exactdedup.exact_dedup(documents, digest=weak).collect(), documents.collect())


def test_empty_table(documents):
    assert exactdedup.exact_dedup(documents.limit(0)).count() == 0


def test_state_outlives_a_run(spark):
    """A second run with the same checkpoint finds digests of the first."""
    checkpoint = scratch_path(spark, "state")
    arrivals = scratch_path(spark, "arrivals")
    at = "struct<id:bigint,file:string,row:bigint>"
    for ids in ([1, 2], [3]):
        df = spark.createDataFrame([(b"d", (i, "f", i)) for i in ids], f"digest binary, at {at}")
        df.write.mode("append").parquet(arrivals)
        exactdedup.run_state(spark, arrivals, checkpoint, df.schema)
    rows = exactdedup.read_state(spark, checkpoint).collect()
    assert [(bytes(r.digest), r["at"].id, r.n) for r in rows] == [(b"d", 3, 3)]


def test_no_python_on_the_main_path(documents):
    plan = exactdedup.exact_dedup(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
