"""Self join of texts by the Jaccard similarity of their word shingles
(operator 3), exact, by universe partition and pigeonhole.

Sets. A text's set holds 64-bit hashes of its distinct shingles. Equal sets are
one node from the start; its digest is checked by a second digest.

Filter. Sizes fall into bands; a set also visits the next band if a partner
there can be similar enough. Hashing divides the universe of shingles of a band
into m segments. A set of size s differs from any similar partner in at most
H = s (q - p) / p shingles (similarity p / q), so of segments whose weights add
up to H + 1 one must be equal in both (weight 1), or differ by one shingle
(weight 2: its one-deletion neighbourhood is indexed too). A set walks its
non-empty segments in order until that sum is reached; whichever of two sets
stops first vouches for the pair. A set that runs out of segments also enters a
space of its own kind, with its empty segments. ``allocate`` picks m and the
number of segments with neighbourhoods per band, by the cost of index rows
against that of checking unrelated candidates, from counts of all sets.

Candidates. Index keys held by one set only are dropped by a count with partial
aggregation. In each other bucket all sets are compared with one pivot; after
that only members of different components are left to compare. They meet in
blocks of bounded size, where sketches of the sets (a byte per segment of a finer
partition, which never rejects a similar pair) are compared in numpy; pairs that
pass become rows. Pairs with a pivot pass the same sketches before their texts
are fetched. So a large group of near copies costs checks in proportion to
its members, not its pairs.

Checks compare whole sets of shingles. No cap on partners or candidates.

Defined results: a null or blank text has the empty set, is linked with nothing
and is its own component; rows with a null identifier link with nothing and
have a null component; repeated rows fall into one component; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.llm.common import discard, maybe_broadcast, small_batches, word_count, written
from tablesense.llm.components import connected_components

CHECK_COST = 60.0   # checking a candidate, in index rows
SHARED = 0.0005     # share of shingles that unrelated texts are taken to have in common
BROADCAST_KEYS = 2_000_000  # 8-byte index keys of a broadcast; more are joined by shuffle
BLOCK = 256         # members of a bucket that meet in one task at once, twice
DELETED, VISITOR = 1, 2  # bits of an index row's role

U = np.uint64
_A, _B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)  # the finalizer of splitmix64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _A
    x = (x ^ (x >> U(27))) * _B
    return x ^ (x >> U(31))


_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=U)  # a random value per byte, A-Z as a-z
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE[_SPACE] = 0
_BASE = _rng.integers(1, 2**64 - 1, dtype=U) | U(1)


class Shingler:
    """Sorted distinct shingle hashes of a text. Words are runs of bytes other
    than white space, A-Z lower-cased; a word's hash is a polynomial over
    random values of its bytes."""

    def __init__(self, k: int):
        self.k = k
        self.power = np.ones(1, dtype=U)

    def words(self, data: bytes) -> np.ndarray:
        b = np.frombuffer(data, dtype=np.uint8)
        space = _SPACE[b]
        start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if not len(start):
            return np.empty(0, dtype=U)
        size = np.diff(np.append(start, len(b)))
        if (longest := int(size.max())) > len(self.power):
            self.power = np.cumprod(np.concatenate([np.ones(1, dtype=U), np.full(2 * longest, _BASE, dtype=U)]), dtype=U)
        b = b[start[0]:]
        start = start - start[0]
        v = _BYTE[b] * self.power[np.arange(len(b)) - np.repeat(start, size)]
        return mix(np.add.reduceat(v, start))

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.words((text or "").encode("utf-8", "surrogatepass"))
        if not len(h):
            return h
        k = min(self.k, len(h))
        n = len(h) - k + 1
        out = mix(h[:n] + U(k))
        for j in range(1, k):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[j:j + n])
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def digest(s: np.ndarray, seed: int) -> int:
    """Order-free 64-bit digest of a set, signed."""
    return int((mix(s + U(seed)).sum(dtype=U) + U(len(s) * 2 + 1)).astype(np.int64))


@dataclass(frozen=True)
class Band:
    lo: int
    m: int        # segments
    near: int     # the first ones have one-deletion neighbourhoods


@dataclass(frozen=True)
class Plan:
    """Bands by size, similarity p / q."""

    p: int
    q: int
    bands: tuple[Band, ...]

    def most(self, size: int) -> int:
        """Shingles by which similar sets may differ (symmetric difference)."""
        return size * (self.q - self.p) // self.p

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band, role) of a size: its own, and the next one as a visitor."""
        b = bisect_right([x.lo for x in self.bands], size) - 1
        out = [(b, 0)]
        if b + 1 < len(self.bands) and size * self.q >= self.bands[b + 1].lo * self.p:
            out.append((b + 1, VISITOR))
        return out


def growth(p: int, q: int) -> float:
    """Of band limits: a third of the sets, by size, visit the next band."""
    return (q / p) ** 3


def limits(p: int, q: int, largest: int) -> list[int]:
    """Least sizes of the bands up to a size."""
    out = [1]
    while (above := math.ceil(max(out[-1] + 1, out[-1] * growth(p, q)))) <= largest:
        out.append(above)
    return out


def allocate(lo: int, hi: int, n: int, p: int, q: int) -> tuple[int, int]:
    """Segments and neighbourhoods for n sets of lo to hi shingles."""
    need = hi * (q - p) // p + 1
    best = None
    for near in sorted({round(need * f / 8) for f in range(5)}):
        m = need - near  # near segments weigh 2
        if m < max(1, near):
            continue
        for _ in range(3):  # room for empty segments of the smallest sets
            empty = m * math.exp(-lo / m)
            m = need - near + math.ceil(empty + 3 * math.sqrt(empty)) if need > 1 else 1
            m = min(m, max(need - near, 4 * hi))
        size = (lo + hi) / 2 / m
        rows = n * (min(m, need) + near * size)
        pairs = n * n / 2 * (m * SHARED ** max(size, 1) + near * size * SHARED ** max(size - 1, 1))
        cost = rows + CHECK_COST * pairs
        if best is None or cost < best[0]:
            best = (cost, m, near)
    return best[1], best[2]


def index_rows(s: np.ndarray, band: int, role: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(keys, roles) of a sorted set in one band."""
    x = plan.bands[band]
    need = plan.most(len(s)) + 1
    seg = ((s >> U(32)) * U(x.m)) >> U(32)  # grows with the hash: segments are runs
    start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    at = seg[start].astype(np.int64)
    count = np.diff(np.append(start, len(s)))
    g = mix(s ^ U(0xD1B54A32D192ED03))
    sums = np.add.reduceat(g, start)
    pays = np.cumsum(1 + ((at < x.near) & (count > 1)))
    short = pays[-1] < need
    take = len(at) if short else int(np.searchsorted(pays, need)) + 1
    key = lambda space, seg, sig: mix(mix(seg.astype(U) + (U(2 * band + space + 1) << U(40))) + sig)
    keys, dels = [key(0, at[:take], sums[:take])], []
    near = np.flatnonzero((at[:take] < x.near) & (count[:take] > 1))
    if len(near):
        end = np.append(start, len(s))[near[-1] + 1]
        owner = np.repeat(np.arange(len(at)), count)[:end]
        ok = np.isin(owner, near)
        dels.append(key(0, at[owner[ok]], sums[owner[ok]] - g[:end][ok]))
    if short:  # meets others that ran out, by empty segments too
        full = np.zeros(x.m, dtype=U)
        full[at] = sums
        keys.append(key(1, np.arange(x.m), full))
        owner = np.repeat(np.arange(len(at)), count)
        ok = at[owner] < x.near
        dels.append(key(1, at[owner[ok]], sums[owner[ok]] - g[ok]))
    n = sum(map(len, keys))
    keys = np.concatenate(keys + dels)
    roles = np.full(len(keys), role | DELETED, dtype=np.int8)
    roles[:n] = role
    return keys.view(np.int64), roles


def index_table(docs: DataFrame, k: int, plan: Plan) -> DataFrame:
    """One pass over the texts. Rows (key, node, role, n, node2): for every
    document one with role -1 and its identifier as key (node null for an empty
    set or a null identifier), then the index rows of its set (n and node2
    null). Copies in one batch are indexed once."""
    names = ["key", "node", "role", "n", "node2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for batch in batches:
            seen, rows, keys, nodes, roles, held = set(), [], [], [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(text)
                if i is None or not len(s):
                    rows.append((i, None, len(s), None))
                    continue
                node = digest(s, 1)
                rows.append((i, node, len(s), digest(s, 2)))
                if node in seen:
                    continue
                seen.add(node)
                for band, role in plan.of(len(s)):
                    got = index_rows(s, band, role, plan)
                    keys.append(got[0])
                    roles.append(got[1])
                    nodes.append(np.full(len(got[0]), node, dtype=np.int64))
                    held += len(got[0])
                if held > 200_000:
                    yield part(keys, nodes, roles)
                    keys, nodes, roles, held = [], [], [], 0
            if held:
                yield part(keys, nodes, roles)
            ids, own, n, second = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(own, pa.int64()), pa.array([-1] * len(rows), pa.int8()),
                pa.array(n, pa.int64()), pa.array(second, pa.int64())], names=names)

    def part(*cols) -> pa.RecordBatch:
        cols = [pa.array(np.concatenate(c)) for c in cols]
        return pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(cols[0]), pa.int64())] * 2], names=names)

    return docs.mapInArrow(run, "key long, node long, role tinyint, n long, node2 long")


def check(pairs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b, ta, tb) whose texts are similar: (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        last: dict[int, np.ndarray] = {}  # the pivot of a run of rows

        def of(node: int, text: str) -> np.ndarray:
            if node not in last:
                if len(last) >= 8:
                    last.clear()
                last[node] = shingles(text)
            return last[node]

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = of(a, ta), shingles(tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(q * both >= p * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return pairs.mapInArrow(run, "a long, b long")


def sketch(s: np.ndarray, width: int) -> np.ndarray:
    """One byte per segment of a finer partition. Sets that differ in d
    shingles differ in at most d bytes."""
    seg = ((s >> U(32)) * U(width)) >> U(32)
    start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    out = np.zeros(width, dtype=np.uint8)
    out[seg[start].astype(np.int64)] = (mix(np.add.reduceat(mix(s ^ U(0xA24BAED4963EE407)), start)) >> U(56)).astype(np.uint8)
    return out


def fetch(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, text, want): the texts of nodes, one document each."""
    wanted = written(nodes.distinct().join(reps, "node").select(F.col("rep").alias("doc_id"), F.col("node").alias("want")), "wanted")
    return docs.join(maybe_broadcast(wanted), "doc_id").select("doc_id", "text", "want")


def sketch_table(found: DataFrame, k: int, plan: Plan, fine: float = 1.5) -> DataFrame:
    """(node, guest, n, sketch) of fetched texts, for each band of a set:
    ``fine`` bytes per shingle of the band's smallest set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for batch in batches:
            rows = []
            for text, want in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = shingles(text)
                if digest(s, 1) == want:  # an identifier may repeat with another text
                    rows += [(want, role, len(s), sketch(s, int(plan.bands[b].lo * fine) + 8).tobytes()) for b, role in plan.of(len(s))]
            cols = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int8(), pa.int64(), pa.binary()), strict=True)],
                                             names=["node", "guest", "n", "sketch"])
    return found.mapInArrow(run, "node long, guest tinyint, n long, sketch binary").dropDuplicates(["node", "guest"])


def blocks(member: DataFrame) -> DataFrame:
    """Deal the members (key, node, role, g) of buckets with several components
    to pairs of blocks of about ``BLOCK`` members, so that any two members of
    different components meet in one: adds label and side. A component of more
    than ``BLOCK`` members has blocks of its own, which do not meet each other:
    a large component costs rows in proportion to the members outside it."""
    per = member.groupBy("key", "g").agg(F.count(F.lit(1)).alias("c"))
    parts = F.ceil(F.col("c") / BLOCK).cast("int")
    own = written(per.groupBy("key").agg(
        F.collect_list(F.when(F.col("c") > BLOCK, F.struct("g", parts.alias("k")))).alias("own"),
        F.ceil(F.coalesce(F.sum(F.when(F.col("c") <= BLOCK, F.col("c"))), F.lit(0)) / BLOCK).cast("int").alias("k"),
        F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("key", "own", "k"), "mixed")
    rows = member.join(own, "key").withColumn("mine", F.get(F.filter("own", lambda x: x["g"] == F.col("g")), F.lit(0)))
    at = F.pmod(F.xxhash64("node"), F.coalesce(F.col("mine.k"), F.col("k"))).cast("int")
    name = lambda g, h: F.concat_ws(":", F.coalesce(g.cast("string"), F.lit("")), F.lpad(h.cast("string"), 10, "0"))
    every = lambda g, k: F.transform(F.sequence(F.lit(0), k - 1), lambda h: name(g, h))
    others = F.flatten(F.transform(F.filter("own", lambda x: F.col("mine").isNull() | (x["g"] != F.col("g"))), lambda x: every(x["g"], x["k"])))
    pool = F.when(F.col("k") > 0, every(F.lit(None), F.col("k"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("block", name(F.when(F.col("mine").isNotNull(), F.col("g")), at)).withColumn("other", F.explode(F.concat(others, pool)))
    return rows.select("key", "node", "role", "g", F.concat_ws("|", F.col("key").cast("string"), F.least("block", "other"), F.greatest("block", "other")).alias("label"),
                       F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))


def by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[list]]]:
    """(label, its rows as columns) of rows sorted by label, the first column."""
    label, held = None, []
    for batch in batches:
        labels = batch.column(0).to_pylist()
        cols = [c.to_pylist() for c in batch.columns[1:]]
        lo = 0
        for at in [i for i in range(1, len(labels)) if labels[i] != labels[i - 1]] + [len(labels)]:
            if at == lo:
                continue
            if labels[lo] != label:
                if label is not None:
                    yield label, held
                label, held = labels[lo], [[] for _ in cols]
            for h, c in zip(held, cols, strict=True):
                h += c[lo:at]
            lo = at
    if label is not None:
        yield label, held


class Forest(dict):
    """Union-find over components."""

    def root(self, i: int) -> int:
        while (up := self.setdefault(i, i)) != i:
            self[i] = self[up]
            i = up
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)
        return a != b


def near_pairs(side: np.ndarray, node: np.ndarray, role: np.ndarray, g: np.ndarray, n: np.ndarray, x: np.ndarray, p: int, q: int) -> np.ndarray:
    """Indexes (i, j), most alike first, of the members of one label that belong
    to different components and whose sketches (rows of x) allow the similarity."""
    spare, left, right = [], [], []
    for i in np.flatnonzero(side < 2):
        other = (g != g[i]) & ((role & role[i]) == 0) & (node != node[i])
        other &= (side == 2) if side[i] == 1 else (np.arange(len(node)) > i)
        at = np.flatnonzero(other)
        if len(at):
            over = (x[at] != x[i]).sum(axis=1) - (q - p) * (n[at] + n[i]) // (q + p)
            spare.append(over[over <= 0])
            right.append(at[over <= 0])
            left.append(np.full(len(right[-1]), i))
    if not spare:
        return np.empty((0, 2), dtype=np.int64)
    order = np.argsort(np.concatenate(spare), kind="stable")
    return np.stack([np.concatenate(left)[order], np.concatenate(right)[order]], axis=1)


def near_by_sketch(rows: DataFrame, p: int, q: int) -> DataFrame:
    """Rows (label, side, node, role, g, n, sketch) of a label are held together
    and their pairs compared in numpy. Of the near ones of different components
    a spanning forest is returned, (a, b, null): no more rows than members,
    however many pairs are near. A tree that leaves out near pairs is returned
    too, as rows (node, tree, label) of its members: if all its pairs prove to
    be links the rest does not matter, else ``exact_links`` goes on from there."""
    def compare(label: str, cols: list) -> tuple[list, list]:
        side, node, role, g, n = (np.array(c) for c in cols[:5])
        x = np.frombuffer(b"".join(cols[5]), dtype=np.uint8).reshape(len(node), -1)
        forest, pairs, seen = Forest(), [], set()
        at = near_pairs(side, node, role, g, n, x, p, q)
        for i, j, gi, gj in zip(*(c.tolist() for c in (node[at[:, 0]], node[at[:, 1]], g[at[:, 0]], g[at[:, 1]])), strict=True):
            pair = (min(i, j), max(i, j))
            if pair not in seen and forest.join(gi, gj):
                pairs.append(pair)
            seen.add(pair)
        more = {forest.root(int(c)) for c in g[at[:, 0]]} if len(seen) > len(pairs) else set()
        count = dict.fromkeys(more, 0)  # near pairs less those returned, by tree
        comp = dict(zip(node.tolist(), g.tolist(), strict=True))
        for a, _ in seen if more else ():
            count[forest.root(comp[a])] += 1
        for a, _ in pairs if more else ():
            count[forest.root(comp[a])] -= 1
        rest = {(i, r) for i in {i for pair in seen for i in pair} if count.get(r := forest.root(comp[i]))}
        return pairs, [(i, r, label) for i, r in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, rest = set(), []
        for label, cols in by_label(batches):
            got = compare(label, cols)
            pairs.update(got[0])
            rest += got[1]
            if len(pairs) + len(rest) > 10_000:
                yield result(pairs, rest)
                pairs, rest = set(), []
        yield result(pairs, rest)

    def result(pairs: set, rest: list) -> pa.RecordBatch:
        cols = zip(*([(a, b, None) for a, b in pairs] + rest), strict=True) if pairs or rest else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["a", "b", "label"])

    together = rows.select("label", "side", "node", "role", "g", "n", "sketch").repartition("label").sortWithinPartitions("label")
    return together.mapInArrow(run, "a long, b long, label string")


def set_table(found: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of fetched texts: the whole set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for batch in batches:
            sets = [(w, shingles(t)) for t, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            rows = [(w, s.tobytes()) for w, s in sets if digest(s, 1) == w]  # an identifier may repeat with another text
            cols = zip(*rows, strict=True) if rows else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary()), strict=True)], names=["node", "shingles"])
    return found.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def exact_links(rows: DataFrame, p: int, q: int) -> DataFrame:
    """Links (a, b) that connect the components of each label as all its links
    would. Rows (label, node, g, shingles) of a label, at most two blocks, are
    held together; whole sets are compared until two components are linked."""
    def compare(node: list, g: list, raw: list) -> list[tuple[int, int]]:
        sets = [np.frombuffer(r, dtype=U) for r in raw]
        n = np.array([len(s) for s in sets])
        x = np.stack([sketch(s, int(n.min()) * 3 // 2 + 8) for s in sets])
        zero, forest, out = np.zeros(len(n), dtype=np.int8), Forest(), []
        for i, j in near_pairs(zero, np.array(node), zero, np.array(g), n, x, p, q).tolist():
            if forest.root(g[i]) != forest.root(g[j]):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if q * both >= p * (n[i] + n[j] - both):
                    forest.join(g[i], g[j])
                    out.append((node[i], node[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in by_label(batches):
            pairs = compare(*cols)
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    together = rows.select("label", "node", "g", "shingles").repartition("label").sortWithinPartitions("label")
    return together.mapInArrow(run, "a long, b long").distinct()


def content(*cols: str) -> list:
    """A 128-bit digest of a group of distinct rows, whatever their order."""
    return [F.bit_xor(F.xxhash64(F.lit(seed), *cols)).alias(name) for seed, name in ((1, "x1"), (2, "x2"))]


def stars_by_sketch(stars: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    """Of pairs (pivot, node, guest: the node visits the pivot's band) those
    (a, b) whose sizes and sketches allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = [np.count_nonzero(np.frombuffer(x, dtype=np.uint8) != np.frombuffer(y, dtype=np.uint8))
                     for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            near = np.array(apart, dtype=np.int64) <= (q - p) * n // (q + p)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    x = sketches.where("guest = 0").select(F.col("node").alias("pivot"), F.col("n").alias("np"), F.col("sketch").alias("xp"))
    y = sketches.select(F.col("node").alias("yn"), F.col("guest").alias("yg"), F.col("n").alias("nn"), F.col("sketch").alias("xn"))
    both = (stars.join(y.drop("xn"), (F.col("node") == F.col("yn")) & (F.col("guest") == F.col("yg"))).drop("yn", "yg")
            .join(x.drop("xp"), "pivot").where((F.least("np", "nn") * q) >= F.greatest("np", "nn") * p).select("pivot", "node", "guest"))
    full = (both.join(x, "pivot").join(y, (F.col("node") == F.col("yn")) & (F.col("guest") == F.col("yg")))
            .select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"), "np", "nn", "xp", "xn"))
    return full.mapInArrow(run, "a long, b long").distinct()


def links_of(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """Written links among candidate pairs (a, b) of nodes."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    found = fetch(docs, reps, nodes)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)  # an identifier may repeat with another text
        for batch in batches:
            want = batch.column(2).to_pylist()
            keep = [digest(shingles(t), 1) == w for t, w in zip(batch.column(1).to_pylist(), want, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1)], names=["node", "text"]).filter(pa.array(keep, pa.bool_()))
    one = written(found.mapInArrow(own, "node long, text string").dropDuplicates(["node"]), "texts")
    both = (pairs.join(one.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .join(one.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))
    links = written(check(both, k, p, q), "links")
    discard(one)
    return links


def jaccard_join(docs: DataFrame, k: int, p: int, q: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest
    identifier reachable by links of similarity >= p / q)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Sizes by words, for the plan only: every set is indexed whatever they are.
    words = F.greatest(word_count(F.col("text")) - (k - 1), F.lit(1)).alias("n")
    sizes = docs.select(F.floor(F.log(words.cast("double")) / math.log(growth(p, q))).alias("x"), words)
    stats = sizes.groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).collect()  # a row per power of the growth
    edges = limits(p, q, max([r.n for r in stats], default=1))
    counts = [sum(r.c for r in stats if bisect_right(edges, r.n) - 1 == i) for i in range(len(edges))]
    plan = Plan(p, q, tuple(Band(lo, *allocate(lo, math.ceil(max(lo + 1, lo * growth(p, q))) - 1, c, p, q))
                            for lo, c in zip(edges, counts, strict=True)))

    rows = written(index_table(docs, k, plan), "index")
    sets = written(rows.where("role = -1").select(F.col("key").alias("doc_id"), "node", "node2", "n"), "sets")
    index = rows.where("role >= 0").select("key", "node", "role")
    same = F.min("node2") == F.max("node2")
    reps = written(sets.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
        F.when(same, 0).otherwise(F.raise_error(F.lit("two sets share a 64-bit digest")).cast("int")).alias("sound")), "nodes")
    often = written(index.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "often")
    held = written(index.join(maybe_broadcast(often, limit=BROADCAST_KEYS), "key").distinct(), "held")
    discard(rows, often)
    pivot = F.min(F.when(F.col("role") == 0, F.col("node"))).alias("pivot")
    buckets = held.groupBy("key").agg(pivot, F.count(F.lit(1)).alias("c"), *content("node", "role")).where("c > 1")
    # Texts that share a passage share many buckets: one of those with the same members stands for all.
    pivots = written(buckets.groupBy("x1", "x2", "c").agg(F.min("key").alias("key"), F.min("pivot").alias("pivot")).drop("x1", "x2"), "pivots")
    guest = F.col("role").bitwiseAND(F.lit(VISITOR)).cast("tinyint")
    stars = written(held.join(pivots.where("pivot IS NOT NULL").select("key", "pivot"), "key").where("node <> pivot").select(
        "pivot", "node", guest.alias("guest")).distinct(), "stars")
    nodes = stars.select("node").unionByName(stars.select(F.col("pivot").alias("node")))
    sketches = written(sketch_table(fetch(docs, reps, nodes), k, plan), "star-sketches")
    tried = written(stars_by_sketch(stars, sketches, p, q), "tried")
    discard(stars, sketches)
    links = links_of(tried, docs, reps, k, p, q)

    group = written(connected_components(links), "groups")
    # The pivot has met all others: two sets are done with, three may not be.
    more = held.join(pivots.where("c > 2 OR pivot IS NULL").select("key", "pivot"), "key").where("pivot IS NULL OR node <> pivot")
    member = written(more.join(group, more.node == group.id, "left").select(
        "key", "node", "role", F.coalesce("component", "node").alias("g")), "members")
    rest = written(blocks(member), "rest")
    discard(held, pivots, member)
    sketches = written(sketch_table(fetch(docs, reps, rest.select("node")), k, plan, fine=0.75), "sketches")  # a copy goes to every block met
    met = rest.join(sketches.withColumnRenamed("node", "sn"), (F.col("node") == F.col("sn")) & (F.col("role").bitwiseAND(F.lit(VISITOR)) == F.col("guest")))
    near = written(near_by_sketch(met, p, q), "near")
    discard(rest, sketches)
    pairs = written(near.where("label IS NULL").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(links_of(pairs, docs, reps, k, p, q))

    trees = near.where("label IS NOT NULL").select(F.concat_ws("|", "label", F.col("b").cast("string")).alias("label"), F.col("a").alias("node"))
    group = written(connected_components(links), "groups")
    trees = written(trees.join(group, trees.node == group.id, "left").select("label", "node", F.coalesce("component", "node").alias("g")), "trees")
    torn = trees.groupBy("label").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), *content("node")).where("lo < hi")
    torn = written(torn.groupBy("x1", "x2").agg(F.min("label").alias("label")).select("label"), "torn")
    trees = written(trees.join(torn, "label"), "torn-trees")
    whole = written(set_table(fetch(docs, reps, trees.select("node")), k), "whole-sets")
    links = links.unionByName(written(exact_links(trees.join(whole, "node"), p, q), "links"))
    discard(near, whole)

    name = reps.select(F.col("node").alias("id"), "rep")
    named = (links.join(name.select(F.col("id").alias("a"), F.col("rep").alias("ra")), "a")
             .join(name.select(F.col("id").alias("b"), F.col("rep").alias("rb")), "b")
             .select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    comp = connected_components(named)
    classes = (reps.join(comp, reps.rep == comp.id, "left").where("copies > 1 OR component IS NOT NULL")
               .select(F.col("node").alias("__node"), F.coalesce("component", "rep").alias("component")))
    classes = maybe_broadcast(written(classes, "classes"))
    return (sets.join(classes, sets.node == F.col("__node"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
