"""Byte-level BPE encoding and decoding (operator 10).

Each Spark task holds one in-process DuckDB connection. A text is cut into
the matches of the tokenizer's pattern; the distinct matches ("words") of a
batch become token-position rows. One recursive query joins neighbouring
tokens to the merge table and contracts, in every step and every word, the
leftmost pair of least rank; a word leaves the recursion when no pair of it
merges. A second query decodes by ordered aggregation of the token bytes.

No shuffle: encoding is row-local. Memory is bounded by the Arrow batch, by
``BATCH_WORDS`` per recursive query and by ``CACHE_CHUNKS`` remembered words.

Defined results: a null text encodes as the empty text (no tokens, empty
bytes); special tokens are ordinary text; repeated rows are encoded each on
its own; an empty table gives an empty result; extra columns are kept, and
columns already named like the results are replaced.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablesense.llm.common import small_batches

BATCH_WORDS = 15_000      # distinct words of one recursive query
CACHE_CHUNKS = 600_000    # remembered chunks of one Python worker
CACHE_WORDS = 1_000_000   # remembered words of one Python worker
DECODE_TOKENS = 400_000   # tokens of one decoding query

ENCODE_SQL = """
WITH RECURSIVE s(it, w, p, t, t2, q, k) AS (
  SELECT 0, x.w, x.p, x.t, x.t2, x.q, (m.r::BIGINT << 32) + x.p
  FROM sym x LEFT JOIN merges m ON m.a = x.t AND m.b = x.t2
  UNION ALL
  SELECT y.it, y.w, y.p, y.t, y.t2, y.q, (m.r::BIGINT << 32) + y.p
  FROM (
    SELECT s.it + 1 AS it, s.w, s.p,
           CASE WHEN s.k = best.k THEN (best.k >> 32)::INT ELSE s.t END AS t,
           CASE WHEN s.k = best.k THEN best.t2
                WHEN s.q = best.p THEN (best.k >> 32)::INT ELSE s.t2 END AS t2,
           CASE WHEN s.k = best.k THEN best.q ELSE s.q END AS q
    FROM s JOIN (
      SELECT c.w, c.k, (c.k & 4294967295)::INT AS p, c.gone, d.q, d.t2
      FROM (SELECT w, min(k) AS k, arg_min(q, k) AS gone
            FROM s WHERE k IS NOT NULL GROUP BY w) c
      JOIN s d ON d.w = c.w AND d.p = c.gone) best ON s.w = best.w
    WHERE s.p <> best.gone) y
  LEFT JOIN merges m ON m.a = y.t AND m.b = y.t2
)
SELECT s.w, s.p, s.t
FROM s JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) e ON e.w = s.w AND e.it = s.it
ORDER BY s.w, s.p
"""
# sym: word w has token t at position p; q and t2 are the next position and its
# token. k packs the rank of (t, t2) above the position, so the least k of a word
# is its leftmost pair of least rank. The row at the pair's second position goes.

DECODE_SQL = """
SELECT i.d AS d, string_agg(v.s, '' ORDER BY i.p) AS s
FROM ids i JOIN vocab v ON v.id = i.t GROUP BY i.d
"""


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """The rank file: one base64 token and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class Codec:
    """One worker's DuckDB connection with merge and vocabulary tables."""

    def __init__(self, raw: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = load_ranks(raw)
        self.findall = regex.compile(pattern).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        cols = np.array(pairs, dtype=np.int32).reshape(-1, 3).T
        self._table("merges", {"a": cols[0], "b": cols[1], "r": cols[2]})
        self._table("vocab", {"id": np.fromiter(self.ranks.values(), np.int32, len(self.ranks)),
                              "s": [t.decode("latin-1") for t in self.ranks]})
        self.single = np.full(256, -1, dtype=np.int32)
        for t, r in self.ranks.items():
            if len(t) == 1:
                self.single[t[0]] = r
        self.cache: dict[str, bytes | None] = {}
        self.known: dict[str, bytes] = {}

    def _table(self, name: str, cols: dict) -> None:
        self.con.register("src", pa.table(cols))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM src").fetchall()
        self.con.unregister("src")

    def _run(self, sql: str, name: str, cols: dict) -> pa.Table:
        self.con.register(name, pa.table(cols))
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            self.con.unregister(name)

    def words(self, words: set[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each distinct word."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        out: dict[str, bytes] = {}
        todo = []
        for w in words:
            got = self.known.get(w)
            if got is None:
                b = w.encode("utf-8")
                r = self.ranks.get(b)
                if r is None:
                    todo.append((w, b))
                    continue
                got = self.known[w] = r.to_bytes(4, "little")
            out[w] = got
        for i in range(0, len(todo), BATCH_WORDS):
            part = todo[i:i + BATCH_WORDS]
            n = np.array([len(b) for _, b in part], dtype=np.int64)
            ends = np.cumsum(n)
            sym = self.single[np.frombuffer(b"".join(b for _, b in part), dtype=np.uint8)]
            if (sym < 0).any():
                raise ValueError("the rank file lacks a token for a single byte")
            pos = (np.arange(len(sym)) - np.repeat(ends - n, n)).astype(np.int32)
            last = np.zeros(len(sym), dtype=bool)
            last[ends - 1] = True
            got = self._run(ENCODE_SQL, "sym", {
                "w": np.repeat(np.arange(len(part), dtype=np.int32), n), "p": pos, "t": sym,
                "t2": pa.array(np.append(sym[1:], 0).astype(np.int32), mask=last),
                "q": pa.array(pos + np.int32(1), mask=last)})
            t = got.column("t").to_numpy().astype("<u4").tobytes()
            at = 4 * np.concatenate([[0], np.cumsum(np.bincount(got.column("w").to_numpy(), minlength=len(part)))])
            for j, (w, _) in enumerate(part):
                out[w] = self.known[w] = t[at[j]:at[j + 1]]
        return out

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks not yet known. A chunk is what stands between single
        spaces; every match of the pattern that holds a space between two
        non-space characters begins with it, so " " + chunk can be matched on
        its own. A chunk that is empty or begins or ends with white space is
        marked None: its text is then matched as a whole."""
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        new = [c for c in chunks if c not in self.cache]
        plain = [c for c in new if c.isalpha()]  # one word, as it stands
        cut = {}
        for c in new:
            if not c or c[0].isspace() or c[-1].isspace():
                self.cache[c] = None
            elif not c.isalpha():
                cut[c] = tuple(self.findall(" " + c))
        ids = self.words({" " + c for c in plain}.union(*cut.values()))
        for c in plain:
            self.cache[c] = ids[" " + c]
        for c, ws in cut.items():
            self.cache[c] = b"".join([ids[w] for w in ws])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")  # one chunk at least
        at = split.offsets.to_numpy()
        chunks = split.flatten().dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        self.learn(distinct)
        known = [self.cache[c] for c in distinct] + [b""]
        codes = chunks.indices.to_numpy().copy()
        firsts = [distinct[i] for i in codes[at[:-1] - at[0]]]
        codes[at[:-1] - at[0]] = len(distinct)  # no space before a text's first chunk
        rest = pc.binary_join(pa.ListArray.from_arrays(pa.array(at - at[0]), pa.array(known, pa.binary()).take(pa.array(codes))), b"")
        out: list[bytes] = []
        whole: dict[int, list[str]] = {}
        for i, (first, ids) in enumerate(zip(firsts, rest.to_pylist(), strict=True)):
            alone = ids is None or (at[i + 1] - at[i] > 1 and (not first or first[-1].isspace()))
            whole[i] = self.findall(texts[i].as_py() if alone else first)
            out.append(b"" if alone else ids)
        ids = self.words(set().union(*whole.values()))
        for i, ws in whole.items():
            out[i] = b"".join([ids[w] for w in ws]) + out[i]
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        out = [b""] * len(ids)
        lo = 0
        while lo < len(ids):
            hi, n = lo, 0
            while hi < len(ids) and (hi == lo or n < DECODE_TOKENS):
                n += len(ids[hi]) // 4
                hi += 1
            part = ids[lo:hi]
            t = np.frombuffer(b"".join(part), dtype="<u4").astype(np.int32)
            if len(t):
                size = np.array([len(x) // 4 for x in part])
                got = self._run(DECODE_SQL, "ids", {
                    "d": np.repeat(np.arange(len(part), dtype=np.int32), size),
                    "p": np.arange(len(t), dtype=np.int32), "t": t})
                for d, s in zip(got.column("d").to_pylist(), got.column("s").to_pylist(), strict=True):
                    out[lo + d] = s.encode("latin-1")
            lo = hi
        return out


_CODECS: dict[str, Codec] = {}  # of this Python worker


def codec(raw: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


def free() -> None:
    """Give back this worker's vocabulary, caches and connection."""
    while _CODECS:
        _CODECS.popitem()[1].con.close()
    gc.collect()
    pa.default_memory_pool().release_unused()


def bpe(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text",
        keep_ids: bool = True, keep_decoded: bool = True, keep: list[str] | None = None,
        release: bool = False) -> DataFrame:
    """Add to ``docs``: n_tokens long, ids array<int>, ids_sha256, decoded
    binary and decoded_sha256. ``ranks_path`` is read on the driver (about a
    MB, fixed by the tokenizer) and broadcast, so executors need no copy.
    ``keep_ids`` / ``keep_decoded`` False leave the long columns out; ``keep``
    lists the columns of ``docs`` to carry (default: all). ``release`` frees a
    worker's vocabulary and caches after each partition, where other work
    follows in the same executors, at the cost of learning words anew."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    added += [("ids", T.ArrayType(T.IntegerType()))] * keep_ids + [("decoded", T.BinaryType())] * keep_decoded
    names = {n for n, _ in added}
    kept = [f for f in docs.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value, pattern)
        for batch in batches:
            gc.disable()  # millions of strings live in the caches; none is in a cycle
            ids = own.encode(batch.column(len(kept)))
            decoded = own.decode(ids)
            cols = [pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
            if keep_ids:
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), dtype="<i4")))
            if keep_decoded:
                cols.append(pa.array(decoded, pa.binary()))
            gc.enable()
            yield pa.RecordBatch.from_arrays(batch.columns[:len(kept)] + cols, names=schema.names)
        if release:
            free()

    return docs.select(*[docs[f.name] for f in kept], docs[text].cast("string").alias("__text")).mapInArrow(run, schema)


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of an installed public vocabulary."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name)), public_tokenizers.PATTERN
