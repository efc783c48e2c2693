import numpy as np
import pytest
import tiktoken

import corpus_pipeline as C
from tablesense.llm import bpe
from tablesense.session import scratch_path

from .test_langid import brute as language
from .test_setjoin import brute as classes


def test_stages_are_named_and_five():
    assert [n for n, _ in C.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "source mixing", "byte-level BPE"]


def test_pipeline_equals_brute_force_stage_by_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    langs = [(r.text, r.lang) for r in rows if r.lang is not None]
    one = C.language_stage(spark, docs, "")
    judged = language(langs, [r.text for r in rows])
    kept = [r for r, (x, p) in zip(rows, judged, strict=True) if x != "und" and p >= C.LEAST_SCORE]
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in kept)

    two = C.exact_stage(spark, one, "")
    last = {}
    for r in kept:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(last.values())

    three = C.near_stage(spark, two, "")
    want = [i for i, _, c in classes([(i, t) for t, i in last.items()], 5, 80, 100) if i == c]
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == sorted(want)

    four = C.mix_stage(spark, three, "").collect()
    times = np.bincount([r.doc_id for r in four], minlength=len(rows))
    assert times.max() <= 2 and set(np.flatnonzero(times)) <= set(want) and len(four) >= len(want)

    mixed = spark.createDataFrame(four, docs.schema)
    path, pattern = bpe.public_vocabulary()
    with open(path, "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    text = {r.doc_id: r.text for r in rows}
    for r in C.encode_stage(spark, mixed, "").collect():
        assert r.ids == enc.encode_ordinary(text[r.doc_id])

    whole = C.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_tokens) for r in whole) == sorted((r.doc_id, len(enc.encode_ordinary(r.text))) for r in four)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_and_empty_table(spark, documents, empty):
    path = scratch_path(spark, "odd")
    (documents.limit(0) if empty else documents).write.parquet(f"{path}/documents.parquet")
    got = C.run(spark, path).collect()
    assert (not got) == empty
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_repeated_identifiers_keep_unrelated_texts(spark):
    """Rows that share an identifier, or have none, are judged each on its text."""
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(3, a), (5, a + " end"), (5, "an unrelated text of some length that nothing else is like"), (None, a + " other"), (None, "one more text without any copy among them all"), (9, "plain")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.text for r in C.near_stage(spark, docs, "").collect()]
    assert len(kept) == 4 and sum(t.startswith("w0 ") for t in kept) == 1
    assert {t for t in kept if not t.startswith("w0 ")} == {t for _, t in rows if not t.startswith("w0 ")}
