import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from tablesense.llm import bpe

PATH, PATTERN = bpe.public_vocabulary()


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read(), PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_equals_the_tokenizer_library_on_odd_texts(codec, reference):
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "a", "the", " the", "　", "\x1c", "\x85", "é", "日本", "\U0001f642", "'s", "'", "1", "½", "!",
             "$$$", "​", "\x00", "<|endoftext|>", " ", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(800)]
    texts += ["", " ", "  a", "a ", "a  b", "x" * 2000, "\n" * 40, " " * 70 + "z", "a \n b", " a"]
    got = codec.encode(pa.array(texts))
    assert [ids(g) for g in got] == [reference.encode_ordinary(t) for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]


def test_small_caches_and_batches_give_the_same(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 5)
    monkeypatch.setattr(bpe, "DECODE_TOKENS", 4)
    texts = [f"some words {i} unusualish{i} zzyzx" for i in range(30)]
    for lo in range(0, 30, 7):
        got = codec.encode(pa.array(texts[lo:lo + 7]))
        assert [ids(g) for g in got] == [reference.encode_ordinary(t) for t in texts[lo:lo + 7]]
        assert codec.decode(got) == [t.encode() for t in texts[lo:lo + 7]]


def test_frame_with_odd_rows_and_clashing_columns(clash, reference):
    got = bpe.bpe(clash, PATH, PATTERN).collect()
    want = {r.doc_id: r.text or "" for r in clash.collect()}
    assert len(got) == clash.count()
    for r in got:
        e = reference.encode_ordinary(want[r.doc_id])
        assert r.ids == e and r.n_tokens == len(e) and bytes(r.decoded) == want[r.doc_id].encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert r.score == "clash"


def test_empty_table(documents):
    got = bpe.bpe(documents.limit(0), PATH, PATTERN, keep=["doc_id"], keep_ids=False, keep_decoded=False)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == 0


def test_released_workers_encode_again(spark, reference):
    """Many partitions through few workers, each freeing its codec."""
    df = spark.createDataFrame([(i, f"text number {i} again") for i in range(60)], "doc_id long, text string").repartition(12)
    got = bpe.bpe(df, PATH, PATTERN, release=True).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == [(i, reference.encode_ordinary(f"text number {i} again")) for i in range(60)]
