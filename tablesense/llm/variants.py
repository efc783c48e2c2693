"""Spelling variant grouping (operator 13).

1. Tasks count the words of their documents (with the planted deletions, if
   asked for) in a bounded table that is flushed when full; Spark adds the
   counts up. Words that are long and frequent enough are the vocabulary.
2. Letters are dealt into ``GROUPS`` groups of about equal frequency. A word's
   frequency vector holds how many of its letters each group has. One inserted,
   deleted or replaced letter raises at most one count by one (surplus) and
   lowers at most one by one (deficit).
3. The trie arranges words by successive counts of the vector. Its top
   ``depth`` levels are a shuffle key; a word is sent as a question to the top
   nodes within the budget that exist. The depth is chosen from the vocabulary,
   so that nodes hold about ``NODE`` words; a node that holds more, or gets more
   questions than ``ASKED``, is dealt into blocks (words times questions), so no
   task holds more than one block of words and one batch of questions.
4. In a task the lower levels are walked depth first by all questions of a batch
   at once: a branch is entered by those whose budget of one surplus and one
   deficit still allows it. The words of a leaf are verified letter by letter
   (common prefix and suffix). Only the number of near words and the best one of
   each question leave the task, never pairs.
5. A word's form is its best near word if that is at least twice as frequent.
   Roots are found by pointer doubling: frequencies double along a chain, so
   its length is at most the logarithm of the largest count.

Defined results: null texts have no words; repeated rows count each; a null
identifier is written as the empty text in the deletion hash; an empty table
gives an empty result; extra columns do not matter. Words of any length are
compared whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesense.llm.common import maybe_broadcast, small_batches, written

PATTERN = "[A-Za-zÀ-ÿ]+"
GROUPS = 12           # letter groups, the levels of the trie
TOP = 6               # levels of the shuffle key at most (43 questions a word); larger nodes are dealt into blocks
NODE = 40_000         # words of a top node held by one block
ASKED = 100_000       # questions put to one block
LEAF = 6              # a branch of so few words is a leaf
BLOCK = 100_000       # question-branch pairs expanded at once
PAIRS = 400_000       # question-word pairs verified at once
TABLE_WORDS = 400_000  # counted words of one task before they are flushed
WHOLE = 1_000_000     # texts up to so many letters are cut into words at once


def runs(text: str, pattern: re.Pattern) -> Counter:
    """Lower-cased (A-Z only) runs of a text, counted."""
    low = text.encode("utf-8").lower().decode("utf-8")  # bytes.lower() changes A-Z alone
    if len(low) <= WHOLE:
        return Counter(pattern.findall(low))
    return Counter(m.group() for m in pattern.finditer(low))


def drop_letter(run: str, base: int, every: int) -> str:
    """The run, without one letter if ``every`` divides the hash that goes on from ``base``."""
    h = zlib.crc32(run.encode("utf-8"), base)
    if h % every:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


def vocabulary(docs: DataFrame, id_col: str, text: str, least_length: int, least_count: int,
               drop_every: int | None, pattern: str) -> DataFrame:
    """word, n: words of all texts that are long and frequent enough, written."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, table = re.compile(pattern), Counter()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base = zlib.crc32(f"{i}:".encode())
                for run, n in runs(t.as_py(), found).items():
                    word = drop_letter(run, base, drop_every) if drop_every else run
                    if len(word) >= least_length:
                        table[word] += n
                if len(table) >= TABLE_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(table)), pa.array(list(table.values()), pa.int64())], names=["word", "n"])
                    table.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("i"), docs[text].cast("string").alias("t")).where("t IS NOT NULL")
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counted.where(F.col("n") >= least_count), "vocabulary")


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """Letters of the vocabulary dealt into groups: the most frequent first,
    each to the group that has least. (One row a letter reaches the driver: the
    alphabet, not the data.)"""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().collect()
    out, load = [""] * groups, [0] * groups
    for r in sorted((r for r in letters if r["c"]), key=lambda r: (-r["count"], r["c"])):
        g = load.index(min(load))
        out[g] += r["c"]
        load[g] += r["count"]
    return out


def counts(word: Column, groups: list[str]) -> list[Column]:
    """The frequency vector: letters of each group in the word."""
    n = F.char_length(word)
    return [n - F.char_length(F.translate(word, g, "")) if g else F.lit(0) for g in groups]


def key_of(vector: list[Column], up: int | None = None, down: int | None = None) -> Column:
    """Key of a top node: its counts, one raised and one lowered."""
    return F.concat_ws(".", *[(c + int(j == up) - int(j == down)).cast("string") for j, c in enumerate(vector)])


def near_keys(vector: list[Column]) -> Column:
    """Keys of the top nodes within a budget of one surplus and one deficit."""
    steps = [None, *range(len(vector))]
    moves = [(u, d) for u in steps for d in steps if u is None or u != d]
    return F.array(*[key_of(vector, u, d) for u, d in moves])


class Trie:
    """Words of one block, sorted by frequency vector: a branch is a range of
    rows, and its children are the runs of the next count in it. ``starts[l]``
    has the first row of every branch at level l, ``keys[l]`` its parent and
    its count in one number."""

    def __init__(self, words: list[str], n: np.ndarray, group_of: np.ndarray, groups: int):
        self.groups, self.group_of = groups, group_of
        flat, at, size = letters(words)
        vec = self.vectors(flat, size)
        order = np.lexsort(vec.T[::-1])
        self.flat, self.at, self.size, self.vec, self.n = flat, at[order], size[order], vec[order], n[order]
        self.edges = edges(self.flat, self.at, self.size)
        self.words = [words[i] for i in order]
        self.rank = np.empty(len(words), np.int64)  # place in code-point order
        self.rank[sorted(range(len(words)), key=self.words.__getitem__)] = np.arange(len(words))
        self.wide = int(self.vec.max(initial=0)) + 4  # counts of a branch's children, with room on either side
        self.starts, self.keys = [np.array([0, len(words)])], [np.zeros(0, np.int64)]
        new = np.zeros(len(words), bool)
        new[0] = True
        for level in range(groups):
            parent = np.cumsum(new) - 1
            col = self.vec[:, level]
            new = new | np.concatenate([[False], col[1:] != col[:-1]])
            first = np.flatnonzero(new)
            self.starts.append(np.append(first, len(words)))
            self.keys.append(np.append(parent[first] * self.wide + col[first] + 1, [np.iinfo(np.int64).max] * 3))

    def vectors(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(size)), size)
        return np.bincount(row * self.groups + self.group_of[flat], minlength=len(size) * self.groups).reshape(len(size), self.groups)

    def ask(self, words: list[str], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each asked word: the number of near words, and count and row of
        the best (largest count, then first in code-point order; row -1: none).
        All words of the block share their first ``depth`` counts."""
        asked = letters(words)
        asked = *asked, edges(*asked)
        vec = self.vectors(asked[0], asked[2])
        answer = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        top = self.vec[0, :depth] - vec[:, :depth]
        up, down = np.maximum(top, 0).sum(1), np.maximum(-top, 0).sum(1)
        q = np.flatnonzero((up <= 1) & (down <= 1))
        stack = [(depth, q, np.zeros(len(q), np.int64), up[q], down[q])]
        while stack:
            level, q, node, up, down = stack.pop()
            if len(q) > BLOCK:  # the later part waits
                stack.append((level, q[BLOCK:], node[BLOCK:], up[BLOCK:], down[BLOCK:]))
                q, node, up, down = q[:BLOCK], node[:BLOCK], up[:BLOCK], down[:BLOCK]
            lo, hi = self.starts[level][node], self.starts[level][node + 1]
            leaf = (hi - lo <= LEAF) | (level == self.groups)
            if leaf.any():
                self._leaves(level, vec, asked, q[leaf], lo[leaf], hi[leaf], up[leaf], down[leaf], answer)
                go = ~leaf
                q, node, up, down = q[go], node[go], up[go], down[go]
            if not len(q):
                continue
            keys = self.keys[level + 1]
            want = node * self.wide + np.minimum(vec[q, level], self.wide - 2) + 1
            at = np.searchsorted(keys, want - 1)  # children with one letter less, as many, one more
            less = keys[at] == want - 1
            same = keys[at + less] == want
            more = keys[at + less + same] == want + 1
            ways = [(less & (down == 0), at, 0, 1), (same, at + less, 0, 0), (more & (up == 0), at + less + same, 1, 0)]
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*[(q[ok], child[ok], up[ok] + u, down[ok] + d) for ok, child, u, d in ways], strict=True))))
        return answer

    def _leaves(self, level, vec, asked, q, lo, hi, up, down, answer) -> None:
        """The words of leaf branches: the budget of the levels not walked, then the letters."""
        ends = np.cumsum(hi - lo)
        i = 0
        while i < len(q):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, side="right")))
            size = hi[i:j] - lo[i:j]
            each = np.repeat(np.arange(i, j), size)
            qs, ws = q[each], np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[each]
            if level < self.groups:
                d = self.vec[ws, level:] - vec[qs, level:]
                total = d.sum(1)  # surplus less deficit
                gone = np.abs(d).sum(1)  # surplus and deficit
                ok = (up[each] + (gone + total) // 2 <= 1) & (down[each] + (gone - total) // 2 <= 1)
                qs, ws = qs[ok], ws[ok]
            self._settle(qs, ws, asked, *answer)
            i = j

    def _settle(self, q, w, asked, near, best_n, best) -> None:
        """Verify pairs and add them to the answers."""
        flat, at, size, edge = asked
        ok = share_an_end(edge[0][q] ^ self.edges[0][w], edge[1][q] ^ self.edges[1][w], np.minimum(size[q], self.size[w]))
        q, w = q[ok], w[ok]
        ok = one_apart(flat, at[q], size[q], self.flat, self.at[w], self.size[w])
        q, w = q[ok], w[ok]
        near += np.bincount(q, minlength=len(near))
        order = np.lexsort((self.rank[w], -self.n[w], q))
        q, w = q[order], w[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        q, w = q[first], w[first]
        old = best[q]
        better = (old < 0) | (self.n[w] > best_n[q]) | ((self.n[w] == best_n[q]) & (self.rank[w] < self.rank[old]))
        best[q[better]], best_n[q[better]] = w[better], self.n[w[better]]


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters on end as code points, where each word begins, its length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat, np.cumsum(size) - size, size


def edges(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first three letters of each word and the last three, from the outer
    one, as numbers (of shorter words they run into the next)."""
    first, last = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(3 if len(flat) else 0):
        first = (first << np.uint64(16)) | flat[np.minimum(at + k, len(flat) - 1)]
        last = (last << np.uint64(16)) | flat[np.maximum(at + size - 1 - k, 0)]
    return first, last


def share_an_end(first: np.ndarray, last: np.ndarray, short: np.ndarray) -> np.ndarray:
    """False only for words more than one edit apart, of the bits that differ in
    their ends: an edit leaves the first or the last two letters alone if
    both words have four or more, three if they have six or more."""
    cut = np.where(short >= 6, 0, 16).astype(np.uint64)
    return (first >> cut == 0) | (last >> cut == 0) | (short < 4)


def one_apart(fa, a, la, fb, b, lb) -> np.ndarray:
    """Whether words (letters fa, beginnings a, lengths la) and (fb, b, lb)
    differ by exactly one inserted, deleted or replaced letter: all but one
    letter of the longer stand in a common prefix and a common suffix."""
    short, long = np.minimum(la, lb), np.maximum(la, lb)
    pre, live = np.zeros(len(a), np.int64), np.flatnonzero(long - short <= 1)
    ok = np.zeros(len(a), bool)
    ok[live] = True
    i = 0
    while len(live):
        live = live[short[live] > i]
        live = live[fa[a[live] + i] == fb[b[live] + i]]
        i += 1
        pre[live] = i
    suf, live, i = np.zeros(len(a), np.int64), np.flatnonzero(ok), 0
    while len(live):
        live = live[short[live] - pre[live] > i]
        live = live[fa[a[live] + la[live] - 1 - i] == fb[b[live] + lb[live] - 1 - i]]
        i += 1
        suf[live] = i
    return ok & (long - pre - suf == 1)


def choose_depth(vectors: DataFrame, groups: int, node: int) -> int:
    """Fewest top levels with which a word shares its node with ``node`` words on average."""
    own = written(vectors.groupBy(*[f"c{j}" for j in range(groups)]).count(), "vector-counts")
    total = vectors.count()
    most = min(TOP, groups)
    for depth in range(1, most):
        sizes = own.groupBy(*[f"c{j}" for j in range(depth)]).agg(F.sum("count").cast("double").alias("n"))
        if (sizes.agg(F.sum(F.col("n") * F.col("n")).alias("s")).first()["s"] or 0.0) <= node * max(total, 1):
            return depth
    return most


def near_words(words: DataFrame, node: int = NODE, asked: int = ASKED, groups: int = GROUPS) -> DataFrame:
    """word, n_near, best (word), best_n of the words (word, n) with a near one."""
    spark = words.sparkSession
    groups_ = letter_groups(words, groups)
    words = written(words.select("word", "n", *[c.alias(f"c{j}") for j, c in enumerate(counts(F.col("word"), groups_))]), "vectors")
    depth = choose_depth(words, groups, node)
    top = [F.col(f"c{j}") for j in range(depth)]

    # Top nodes: words, questions, and so the blocks of either.
    homes = written(words.groupBy(*top).agg(F.count(F.lit(1)).alias("n")).withColumn("key", key_of(top)).withColumn("near", near_keys(top)), "nodes")
    heard = homes.select(F.explode("near").alias("key"), "n").groupBy("key").agg(F.sum("n").alias("q"))
    blocks = written(homes.select("key", "n").join(heard, "key").select(
        "key", F.ceil(F.col("n") / node).cast("int").alias("wb"), F.ceil(F.col("q") / asked).cast("int").alias("qb")), "blocks")
    rows = blocks.count()

    hash_ = F.abs(F.xxhash64("word") % 1_000_003)
    every = lambda b: F.explode(F.sequence(F.lit(0), F.col(b) - 1))
    held = (words.withColumn("key", key_of(top)).join(maybe_broadcast(blocks, rows), "key")
            .select("key", (hash_ % F.col("wb")).cast("int").alias("w"), every("qb").alias("q"), F.lit(0).alias("side"), "word", "n"))
    put = (words.select("word", "n", F.explode(near_keys(top)).alias("key")).join(maybe_broadcast(blocks, rows), "key")
           .select("key", every("wb").alias("w"), (hash_ % F.col("qb")).cast("int").alias("q"), F.lit(1).alias("side"), "word", "n"))
    group_of = np.zeros(256, np.int64)  # PATTERN has no letter beyond U+00FF
    for g, cs in enumerate(groups_):
        for c in cs:
            group_of[ord(c)] = g

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words_, ns, trie = None, [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True))
            side, word, n = (batch.column(j).to_pylist() for j in (3, 4, 5))
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo] and side[hi] == side[lo]:
                    hi += 1
                if keys[lo] != at:
                    at, words_, ns, trie = keys[lo], [], [], None
                if side[lo] == 0:  # the block's words come first
                    words_ += word[lo:hi]
                    ns += n[lo:hi]
                elif words_:
                    trie = trie or Trie(words_, np.array(ns, np.int64), group_of, groups)
                    near, best_n, best = trie.ask(word[lo:hi], depth)
                    hit = np.flatnonzero(near)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([word[lo + i] for i in hit], pa.string()), pa.array(near[hit]),
                        pa.array([trie.words[i] for i in best[hit]], pa.string()), pa.array(best_n[hit])], names=["word", "near", "best", "best_n"])
                lo = hi

    small_batches(spark, 10_000)
    dealt = held.unionByName(put).repartition("key", "w", "q").sortWithinPartitions("key", "w", "q", "side")
    got = dealt.mapInArrow(answer, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("b")))
    return got.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("x")).select(
        "word", "n_near", F.col("x.b").alias("best"), (-F.col("x.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the rows (word, form) that have a form: the last word
    that forms lead to. Each round halves the steps that are left."""
    now = written(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = now.join(maybe_broadcast(ahead), "root", "left")
        now = written(step.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3,
                      ratio: int = 2, drop_every: int | None = None, pattern: str = PATTERN, node: int = NODE, asked: int = ASKED) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the texts.
    ``drop_every`` deletes a letter from one in so many runs (a planted
    misspelling), told by a hash of the identifier and the run."""
    words = vocabulary(docs, id_col, text, least_length, least_count, drop_every, pattern)
    near = near_words(words, node, asked)
    found = F.col("best_n") >= ratio * F.col("n")
    forms = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(found, F.col("best")).alias("form"),
        F.when(found, F.col("best_n")).alias("form_n")), "forms")
    return forms.join(maybe_broadcast(roots(forms)), "word", "left").withColumn("root", F.coalesce("root", "word"))
