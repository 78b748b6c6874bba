"""SimHash near-duplicates over BK-trees.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints within ``radius`` bits
agree wholly in at least ``m - radius`` of m blocks, so each distinct fingerprint goes to one
shard for every choice of that many blocks; a BK-tree is grown in each shard (children keyed by
the integer Hamming distance to their parent) and every member searches its own shard's tree,
following only edges within the radius. Each pair in reach meets in at least one shard, so the
result is exact. Trees go to the shard's task by the shuffle instead of a broadcast, because
their total size grows with the corpus. A shard gives one edge per member, to the
smallest member it is linked with inside the shard, so large groups give no pair lists.

``similar_groups`` finds documents of a Jaccard similarity of word shingles instead, which few bits don't
tell. Its fingerprints have 128 bits, and shards are keyed by bands of min-hashes, a fixed number of them at any size of
the corpus, since unlike texts hardly ever share one. A BK-tree in each shard finds the members within a wide radius,
and the shard gives their minimum spanning forest, in fewer edges than members. Shingle sets decide each edge
exactly. As an edge that fails says nothing of the other pairs, shards whose members then are of several components get the
members' shingle sets, and every pair within the radius that components still part is decided there. A hot shard is first
checked against a few pivots; where components still part it, it is dealt out by further bands, in the end by blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, pi
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesmith.llm.common import components, dropped, released, small, written

SEED = 42
BITS = 64
#: Mean members a shard should have; more blocks are used beyond it.
SHARD_MEAN = 64
#: A shard of more members is dealt out again by its other bits.
SHARD_MOST = 8192
#: Pairs of query and tree node held at once in a task.
FRONTIER = 1 << 18
#: Rows of sorted shards that a task works on at once, or one shard if it is larger.
SHARD_ROWS = 1 << 16
#: Shingles of a text hashed at once.
CHUNK = 1 << 14


def fingerprint(text: str | None, k: int = 3) -> int:
    """SimHash of the k-word shingles, repeats included; 0 for a text without words."""
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    n = max(1, len(w) - k + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        m = min(CHUNK, n - at)
        part = w[at : at + m + k - 1]
        shingles = map(b" ".join, zip(*(part[i : i + m] for i in range(k)))) if len(w) >= k else [b" ".join(w)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row. A null text counts as empty."""

    return _hashed_fingerprints(docs, k, id_col, text_col).select("doc_id", "fp")


def _hashed_fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """With a hash of the text beside."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), k) for t in b.column(2)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, hash long, fp long")


class Forest:
    """BK-trees of many shards at once, as arrays; rows sorted by shard, fingerprints distinct in a shard.

    fp: a column of 64 bits or several.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray) -> None:
        n = len(fp)
        self.fp = np.ascontiguousarray(fp).reshape(n, -1).view(np.uint64)  # bitwise_count takes absolute values of signed numbers
        most = BITS * self.fp.shape[1]
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        rows, at = np.flatnonzero(self.root != np.arange(n)), self.root.copy()
        while len(rows):  # one level of all trees: of the rows below a node, the first at each distance is its child
            d = self.distance(rows, at[rows])
            slot, head, back = np.unique(at[rows] * (most + 1) + d, return_index=True, return_inverse=True)
            child = rows[head]
            parent[child], edge[child] = at[rows[head]], d[head]
            at[rows] = child[back]
            rows = rows[at[rows] != rows]
        self.order = np.argsort(parent, kind="stable")
        self.edge = edge[self.order]
        self.lo = np.searchsorted(parent[self.order], np.arange(n), "left")
        self.hi = np.searchsorted(parent[self.order], np.arange(n), "right")

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[a] ^ self.fp[b]).sum(1, dtype=np.int64)

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of each shard within the radius, and their distance, in parts."""
        q = np.arange(len(self.fp))
        stack = [(q[i : i + FRONTIER], self.root[i : i + FRONTIER]) for i in range(0, len(q), FRONTIER)]
        while stack:
            q, node = stack.pop()
            d = self.distance(q, node)
            hit = (d <= radius) & (q != node)
            if hit.any():
                yield q[hit], node[hit], d[hit]
            n = self.hi[node] - self.lo[node]
            ends = np.cumsum(n)
            for a, b in _parts(ends):
                m = n[a:b]
                total = int(m.sum())
                if not total:
                    continue
                kid = np.repeat(self.lo[node[a:b]] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(total)
                near = np.abs(self.edge[kid] - np.repeat(d[a:b], m)) <= radius
                stack.append((np.repeat(q[a:b], m)[near], self.order[kid[near]]))


def _parts(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + FRONTIER, "right")))
        yield a, b
        a = b


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the pairs in a forest of smallest members; in place."""
    while len(a):
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        np.minimum.at(parent, a, b)


def shard_links(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint linked with it in its shard), rows that are not their own."""
    order = np.lexsort((fp, shard))
    shard, fp = shard[order], fp[order]
    keep = np.r_[True, (shard[1:] != shard[:-1]) | (fp[1:] != fp[:-1])]
    shard, fp = shard[keep], fp[keep]
    alone = np.r_[True, shard[1:] != shard[:-1]] & np.r_[shard[1:] != shard[:-1], True]
    shard, fp = shard[~alone], fp[~alone]
    if not len(fp):
        return fp, fp
    parent = np.arange(len(fp))
    for a, b, _ in Forest(shard, fp).pairs(radius):
        _joined(parent, a, b)
    _joined(parent, parent[:1], parent[:1])
    while not np.array_equal(parent[parent], parent):
        parent = parent[parent]
    far = parent != np.arange(len(fp))
    return fp[far], fp[parent[far]]


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of some shards, none of them cut; rows come sorted by the first column."""
    held: list[list[np.ndarray]] = []
    rows, wanted = 0, SHARD_ROWS
    for x in batches:
        held.append([c.to_numpy() for c in x.columns])
        rows += x.num_rows
        if rows >= wanted:
            cols = [np.concatenate(c) for c in zip(*held)]
            end = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last shard may go on in the next batch
            if end:
                yield [c[:end] for c in cols]
            held, rows = [[c[end:] for c in cols]], len(cols[0]) - end
            wanted = max(SHARD_ROWS, 2 * rows)
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _search(radius: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, fp in _whole_shards(batches):
            a, b = shard_links(shard, fp, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _cuts(bits: int, blocks: int) -> list[tuple[int, int]]:
    ends = [bits * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _picked(parts: list[tuple[int, int]]) -> F.Column:
    """A number made of some bit ranges of fp."""
    out = F.lit(0).cast("long")
    for at, n in parts:
        out = F.shiftleft(out, n).bitwiseOR(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1).cast("long")))
    return out


def sharded(fps: DataFrame, radius: int, rows: int) -> DataFrame:
    """(shard long, fp long): each pair within the radius shares at least one shard.

    As many blocks are used as it takes for shards of SHARD_MEAN members at even bits. Shards
    beyond SHARD_MOST are dealt out again by radius + 1 blocks of their remaining bits, which
    keeps every pair, until they fit or no bits are left.
    """
    m = radius + 1
    while m < 2 * radius + 2 and rows / 2 ** (BITS * (m - radius) // m) > SHARD_MEAN and comb(m, radius) < 200:
        m += 1
    blocks = _cuts(BITS, m)
    picks = [(i, list(c)) for i, c in enumerate(combinations(blocks, m - radius))]
    rest = {i: [(at, n) for at, n in blocks if (at, n) not in c] for i, c in picks}
    made = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), _picked(c).alias("key")) for i, c in picks)))
    out = fps.select("fp", made.alias("s")).select("fp", F.col("s.t").alias("t"), F.xxhash64("s.t", "s.key").alias("shard"))
    ready: list[DataFrame] = []
    for _ in range(3):
        hot = written(out.groupBy("shard").count().where(F.col("count") > SHARD_MOST).select("shard"), "hot")
        if hot.isEmpty():
            break
        ready.append(out.join(small(hot), "shard", "left_anti"))
        again, rest2 = None, {}
        for i, left in rest.items():
            bits = [(at + j, 1) for at, n in left for j in range(n)]
            if len(bits) <= radius:
                continue
            for j, (at, n) in enumerate(_cuts(len(bits), radius + 1)):
                t = i * (radius + 1) + j
                rest2[t] = bits[:at] + bits[at + n :]
                again = again or []
                again.append((i, t, bits[at : at + n]))
        cases = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), _picked(c).alias("key")) for i, t, c in again)))
        out = out.join(small(hot), "shard", "left_semi").select("fp", "shard", "t", cases.alias("s")).where("t = s.i").select("fp", F.col("s.t").alias("t"), F.xxhash64("shard", "s.t", "s.key").alias("shard"))
        rest = rest2
    for x in ready:
        out = out.unionByName(x)
    return out.select("shard", "fp")


def near_groups(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(fp long, root long, component_id long) of every distinct fingerprint of (doc_id, fp) rows.

    root: a fingerprint that stands for the group. component_id is the smallest doc_id among all documents reachable by links of at most
    ``radius`` bits. Null ids are passed over; a group of null ids only has a null id.
    """
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    links = sharded(nodes.select("fp"), radius, nodes.count())
    found = links.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search(radius), "a long, b long")
    root = written(components(found), "roots")
    own = nodes.join(root, nodes.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    own = written(own, "own")
    least = written(own.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    out = written(own.join(small(least), "root").select("fp", "root", "component_id"), "groups")
    for x in (nodes, root, own, least):
        dropped(x)
    return out


def simhash_groups(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows and
    texts share a fingerprint; an empty table gives no rows; other columns of docs are not read.
    """
    fps = written(fingerprints(docs, k), "docfps")
    return fps.join(near_groups(fps, radius), "fp").select("doc_id", "fp", "component_id")


# ---- by similarity of shingle sets ----

WIDE = 128
#: Min-hashes of a band. A pair at similarity s shares a band with a chance of s ** BAND; as many bands are made as RECALL takes.
BAND = 4
#: Chance that a pair at the similarity shares a band; more similar pairs share one more often.
RECALL = 0.999
#: Distinct shingles of all members together beyond which a shard is hot, as it is beyond SHARD_MOST members.
SHARD_SHINGLES = 1 << 21
#: Members of a hot shard that all others are checked with first.
PIVOTS = 4
#: Shingles of whole shards that a task decides at once, or those of one shard if it is larger.
TASK_SHINGLES = 1 << 19
#: Times that a hot shard in which components still differ is dealt out by further bands, before it is searched in blocks.
DEEPER = 2
#: Distinct words whose hashes a task keeps.
KNOWN_WORDS = 1 << 18


def shingles(text: str | None, k: int) -> set[bytes]:
    """Distinct k-word shingles; of fewer words the whole sequence, of none nothing."""
    w = text.encode().lower().split() if text else []
    return set(map(b" ".join, zip(*(w[i:] for i in range(k))))) if len(w) >= k else {b" ".join(w)} if w else set()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_hashes(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles, made of the hashes of their words."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    m = min(k, len(w))
    out = np.full(len(w) - m + 1, m, np.uint64)
    for i in range(m):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - m + 1 + i]
    return np.unique(_mixed(out))


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """SimHash of WIDE bits of a set of shingle hashes, as two int64; zeros for an empty set."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(own), CHUNK):
        part = own[at : at + CHUNK]
        h = np.stack([_mixed(part ^ np.uint64(salt)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], 1)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(own)).view(np.int64)


def _bands(similarity: float) -> int:
    return ceil(log(1 - RECALL) / log(1 - similarity**BAND))


def _factors(n: int, salt: int) -> np.ndarray:
    """Odd factors: a product modulo 2 ** 64 permutes the hashes."""
    pick = Random(salt)
    return np.array([pick.getrandbits(64) | 1 for _ in range(n)], np.uint64)[:, None]


def band_keys(own: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.min([(factors * own[at : at + CHUNK]).min(1) for at in range(0, len(own), CHUNK)], axis=0).reshape(-1, BAND)
    key = np.arange(len(least), dtype=np.uint64)
    for i in range(BAND):
        key = _mixed(key ^ least[:, i])
    return key.view(np.int64)


def _differing(similarity: float) -> float:
    """Expected share of differing bits of two sets of one size: the angle between them over pi."""
    return acos(2 * similarity / (1 + similarity)) / pi


def _radius(similarity: float) -> int:
    """Four deviations above the expected distance at the similarity, which ties in very small sets raise by a quarter at most."""
    p = 1.25 * _differing(similarity)
    return ceil(WIDE * p + 4 * (WIDE * p * (1 - p)) ** 0.5)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def _described(k: int, factors: np.ndarray):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            sets = [shingle_hashes(t.as_py(), k, known) for t in b.column(2)]
            fps = np.stack([wide_fingerprint(x) for x in sets]) if sets else np.zeros((0, 2), np.int64)
            same = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in sets]), np.int64).reshape(-1, 2)
            cols = [pa.array(x.copy()) for x in (*same.T, *fps.T)]
            size = pa.array(np.array([len(x) for x in sets], np.int64))
            own = [x.view(np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, size, _lists([band_keys(x, factors) for x in sets]), _lists(own)], ["doc_id", "hash", "s0", "s1", "f0", "f1", "size", "bands", "shingles"])

    return run


def described(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """A stored row for each row of docs: a number of its own, doc_id, hash of its text, 128-bit hash of its shingle set, SimHash, size, band keys and shingle hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.col("text").alias("text"))
    kinds = "doc_id long, hash long, s0 long, s1 long, f0 long, f1 long, size long, bands array<long>, shingles array<long>"
    rows = rows.mapInArrow(_described(k, _factors(BAND * _bands(similarity), 0)), kinds)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "shingled")


def _forest_edges(radius: int):
    """Minimum spanning forest, by distance, of each shard's pairs within the radius."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, node, f0, f1 in _whole_shards(batches):
            many = np.r_[False, shard[1:] == shard[:-1]] | np.r_[shard[1:] == shard[:-1], False]
            shard, node, fp = shard[many], node[many], np.stack([f0[many], f1[many]], 1)
            kept = tuple(np.zeros(0, np.int64) for _ in range(3))
            held, n = [], 0
            for part in Forest(shard, fp).pairs(radius) if len(node) else ():
                held.append(part)
                n += len(part[0])
                if n >= FRONTIER:
                    kept, held, n = _spanning(len(node), *(np.concatenate(c) for c in zip(kept, *held))), [], 0
            if held:
                kept = _spanning(len(node), *(np.concatenate(c) for c in zip(kept, *held)))
            a, b = node[kept[0]], node[kept[1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _spanning(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a minimum spanning forest over n nodes, nearest first."""
    parent, out = np.arange(n), []
    for level in np.unique(d):
        now = np.flatnonzero(d == level)
        while len(now):
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            ra, rb = parent[a[now]], parent[b[now]]
            apart = ra != rb
            now, ra, rb = now[apart], ra[apart], rb[apart]
            top, low = np.maximum(ra, rb), np.minimum(ra, rb)
            roots, first = np.unique(top, return_index=True)  # each root hooks to one smaller root
            parent[roots] = low[first]
            out.append(now[first])
    ix = np.concatenate(out) if out else np.zeros(0, np.int64)
    return a[ix], b[ix], d[ix]


def _shard_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole shards, of about TASK_SHINGLES shingles together; rows come sorted by the first column."""
    held, n, wanted = [], 0, TASK_SHINGLES
    for x in batches:
        held.append(x)
        n += x.num_rows + len(x.column(x.num_columns - 1).flatten())
        if n >= wanted:
            t = pa.Table.from_batches(held).combine_chunks()
            shard = t.column(0).to_numpy()
            end = int(np.searchsorted(shard, shard[-1], "left"))  # the last shard may go on in the next batch
            if end:
                yield t.slice(0, end)
            held = t.slice(end).to_batches()
            n = sum(y.num_rows + len(y.column(y.num_columns - 1).flatten()) for y in held)
            wanted = max(TASK_SHINGLES, 2 * n)
    if held:
        yield pa.Table.from_batches(held)


def _joining(similarity: float, radius: int):
    """Pairs of roots (a < b) that some pair of similar members of a shard joins, from rows (shard, node, f0, f1, root, shingles).

    Every pair within the radius whose roots still differ is decided by its shingles.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shard_tables(batches):
            shard, _, f0, f1, root = (t.column(i).to_numpy() for i in range(5))
            lists = t.column(5).combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(sizes)
            flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
            seen = np.zeros(int(flat.max(initial=0)) + 1, bool)
            roots, at = np.unique(root, return_inverse=True)
            parent, out = np.arange(len(roots)), []

            def up(x: int) -> int:
                while parent[x] != x:
                    x = parent[x] = parent[parent[x]]
                return x

            for q, x, _ in Forest(shard, np.stack([f0, f1], 1)).pairs(radius):
                while not np.array_equal(top := parent[parent], parent):
                    parent[:] = top
                # each pair is met from both ends; sizes too unlike rule the similarity out
                ok = (q < x) & (parent[at[q]] != parent[at[x]]) & (np.minimum(sizes[q], sizes[x]) >= similarity * np.maximum(sizes[q], sizes[x]))
                q, x = q[ok], x[ok]
                order = np.argsort(q, kind="stable")
                q, x = q[order], x[order]
                for i, j in _runs(q):
                    for s in range(i, j, 4096):
                        one, many = q[i], x[s : min(j, s + 4096)]
                        mine = flat[ends[one] - sizes[one] : ends[one]]
                        seen[mine] = True
                        m = sizes[many]
                        last = np.cumsum(m)
                        hits = seen[flat[np.repeat(ends[many] - last, m) + np.arange(last[-1])]]
                        both = np.diff(np.r_[0, np.cumsum(hits)[last - 1]])
                        seen[mine] = False
                        for y in many[both >= similarity * (sizes[one] + m - both)]:
                            a, b = up(at[one]), up(at[y])
                            if a != b:
                                parent[max(a, b)] = min(a, b)
                                out.append((roots[min(a, b)], roots[max(a, b)]))
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return run


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]) if len(x) else np.zeros(1, np.int64)
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def _deeper(factors: np.ndarray):
    """Rows (shard, node, f0, f1, root, size) for each further band, from the same rows with their shingles."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = b.column(6)[i].values.to_numpy().view(np.uint64)
                keys = band_keys(own, factors).view(np.uint64)
                shard = _mixed(keys ^ _mixed(np.full(len(keys), b.column(0)[i].as_py(), np.int64).view(np.uint64))).view(np.int64)
                same = [pa.array(np.full(len(keys), b.column(c)[i].as_py(), np.int64)) for c in range(1, 6)]
                yield pa.RecordBatch.from_arrays([pa.array(shard), *same], b.schema.names[:6])

    return run


def _is_hot() -> F.Column:
    return (F.col("n") > SHARD_MOST) | (F.col("sizes") > SHARD_SHINGLES)


def _hot(dealt: DataFrame) -> DataFrame:
    return written(dealt.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("sizes")).where(_is_hot()).select("shard"), "hot")


def _pivot_edges(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b): the members of each hot shard with each of its pivots, within the radius."""
    least = rows.groupBy("shard", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("part")).agg(F.min(F.struct("node", "f0", "f1")).alias("p"))
    pivots = small(written(least.select("shard", F.col("p.node").alias("pivot"), F.col("p.f0").alias("p0"), F.col("p.f1").alias("p1")), "pivots"))
    far = F.bit_count(F.col("f0").bitwiseXOR(F.col("p0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("p1")))
    return rows.join(pivots, "shard").where((F.col("node") != F.col("pivot")) & (far <= radius)).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def _mixed_shards(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(shard, node, f0, f1, root): shards of bounded size of rows (shard, node, f0, f1, root, size) in which roots differ.

    Each pair of members with different roots stays in one of them: surely where blocks are made, else with the chance RECALL
    for each time that a hot shard is dealt out.
    """
    factors, ready = _bands(similarity) * BAND, []
    columns = ["shard", "node", "f0", "f1", "root", "size"]
    for level in range(DEEPER + 1):
        sums = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        sums = written(sums.where("lo <> hi").select("shard", "n", "sizes", _is_hot().alias("hot")), "mixed")
        ready.append(rows.join(small(sums.where("not hot").select("shard")), "shard", "left_semi").select(columns))
        hot = sums.where("hot")
        if hot.isEmpty():
            break
        if level < DEEPER:
            again = rows.join(small(hot.select("shard")), "shard", "left_semi").select(columns).join(sets, "node")
            again = again.select(*columns, "shingles").mapInArrow(_deeper(_factors(factors, level + 1)), ", ".join(f"{c} long" for c in columns))
            rows = written(again, "deeper")
        else:  # pairs of blocks: each pair of members meets once
            most = F.greatest(F.ceil(2 * F.col("n") / SHARD_MOST), F.ceil(2 * F.col("sizes") / SHARD_SHINGLES)).cast("int")
            own = rows.join(small(hot.select("shard", most.alias("m"))), "shard").withColumn("p", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
            own = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
            ready.append(own.withColumn("shard", F.xxhash64("shard", F.least("p", "o"), F.greatest("p", "o"))).select(columns))
    out = ready[0]
    for x in ready[1:]:
        out = out.unionByName(x)
    return out.drop("size")


def similar_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, hash, root, component_id), a stored row for each row of docs: groups linked by a Jaccard similarity of at least ``similarity``.

    The sets are the distinct k-word shingles. Texts without words are alike. hash is that of the
    text, root numbers the group, component_id is its smallest doc_id, null if none has one. Repeated rows and equal texts share
    a group; an empty table gives no rows; other columns are not read.
    """
    rows = described(docs, k, similarity)
    about = F.struct("row", "f0", "f1", "size", "bands").alias("one")
    nodes = rows.groupBy("s0", "s1").agg(F.min("doc_id").alias("least"), F.min_by(about, "row").alias("one"))
    nodes = written(nodes.select("s0", "s1", "least", F.col("one.row").alias("node"), "one.f0", "one.f1", "one.size", "one.bands"), "nodes")
    radius = _radius(similarity)
    dealt = nodes.select(F.explode("bands").alias("shard"), "node", "f0", "f1", "size")
    hot = _hot(dealt)
    any_hot = not hot.isEmpty()
    cool = dealt.join(small(hot), "shard", "left_anti") if any_hot else dealt
    cool = cool.select("shard", "node", "f0", "f1").repartition("shard").sortWithinPartitions("shard")
    edges, crowded = cool.mapInArrow(_forest_edges(radius), "a long, b long"), None
    if any_hot:
        crowd = dealt.join(small(hot), "shard", "left_semi")
        edges, crowded = edges.union(_pivot_edges(crowd.select("shard", "node", "f0", "f1"), radius)), crowd.select("node").distinct()
    edges = written(edges.distinct(), "candidates")
    asked = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = written(asked.union(crowded).distinct() if crowded is not None else asked, "asked")
    sets = rows.select(F.col("row").alias("node"), "shingles").join(small(asked), "node", "left_semi")
    sets = written(sets, "sets")
    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    same = both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both)
    links = written(edges.join(x, "a").join(y, "b").where(same).select("a", "b"), "links")
    root = written(components(links), "roots")
    # an edge that fails says nothing of a shard's other pairs: those that components still part are decided too
    own = F.coalesce("root", "node").alias("root")
    left = nodes.join(asked, "node", "left_semi").join(root, "node", "left").select("node", "f0", "f1", "size", "bands", own)
    left = written(left.select(F.explode("bands").alias("shard"), "node", "f0", "f1", "root", "size"), "left")
    mixed = _mixed_shards(left, sets, similarity).join(sets, "node").select("shard", "node", "f0", "f1", "root", "shingles")
    more = mixed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_joining(similarity, radius), "a long, b long")
    more = components(written(more.distinct(), "joined")).select(F.col("node").alias("_r"), F.col("root").alias("_top"))
    grouped = nodes.join(root, "node", "left").select("s0", "s1", "least", own)
    grouped = written(grouped.join(more, grouped["root"] == more["_r"], "left").select("s0", "s1", "least", F.coalesce("_top", "root").alias("root")), "grouped")
    least = written(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    groups = grouped.join(small(least), "root").select("s0", "s1", "root", "component_id")
    out = written(rows.select("doc_id", "hash", "s0", "s1").join(groups, ["s0", "s1"]).select("doc_id", "hash", "root", "component_id"), "similar")
    for t in (rows, nodes, hot, edges, asked, sets, links, root, left, grouped, least):
        dropped(t)
    return out


def near_deduplicated(docs: DataFrame, k: int = 5, similarity: float | None = 0.8, radius: int = 3) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, of these the one of the smallest hash of its text.

    Groups by similarity of shingle sets, or with ``similarity=None`` by fingerprints within the radius. Rows are judged by
    doc_id and text: rows of one doc_id with unlike texts are in groups of their own, null ids come last. Of rows that repeat
    both, one stays. An empty table stays empty.
    """
    if similarity is not None:
        members = similar_groups(docs, k, similarity)
    else:
        fps = written(_hashed_fingerprints(docs, k), "docfps")
        members = fps.join(near_groups(fps.select("doc_id", "fp"), radius), "fp").select("doc_id", "hash", "root")
    keys = written(members.groupBy("doc_id", "hash").agg(F.min("root").alias("root"), F.count("*").alias("n")), "keys")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")
    best = written(keys.groupBy("root").agg(F.min(order).alias("best")), "best")
    judged = keys.join(small(best), "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("hash") == F.col("best.hash")))
    judged = written(judged.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "stays", "n"), "judged")
    for t in (keys, best, members):
        dropped(t)

    def by_row(rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
        side = small(side.select("_id", "_hash"))
        return rows.join(side, rows["doc_id"].cast("long").eqNullSafe(side["_id"]) & (F.xxhash64(rows["text"]) == side["_hash"]), how).select(rows.columns)

    kept = by_row(docs, judged.where("not stays"), "left_anti")
    again = judged.where("stays and n > 1")
    if again.isEmpty():
        return kept
    return by_row(kept, again, "left_anti").unionByName(by_row(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))
