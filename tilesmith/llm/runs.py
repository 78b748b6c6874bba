"""Runs of repeated word sequences: maximal stretches of a text that go on with a period.

The suffix tree of each text is walked as Stoye and Gusfield do it: at a node of depth d, each leaf outside the
largest child is asked whether the leaf d words on, or d words back, is below the same node in another child; if so, a
tandem repeat of period d branches there. Rotating it to the left as far as words agree gives a run, and repeats that end up
in one stretch are merged into the run of the smallest period.

A tree is held as arrays: suffixes in order, the length that neighbours share, and for each node its range of leaves. Ranks of
all stretches of 1, 2, 4, 8... words, from which the order comes, also tell how far two places agree, to the right and to the
left. Only nodes of depth ``least // 4 + 1`` or more are made: a run of ``least`` words also repeats with a multiple of
its period which is that large, and its smallest period is found at the end. So words that start no such repeated
stretch cost one look. A task holds BLOCK_WORDS words, or one longer text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesmith.llm.common import fresh, released

#: Words of whole texts searched at once.
BLOCK_WORDS = 1 << 18
#: What separates words: blank, tab and line ends of ASCII.
WORD = r"[^\x20\x09-\x0D]+"


class _Ranks:
    """For each length 1, 2, 4...: a rank for each place, equal if and only if that many words from there are equal.

    Ranks count the smaller ones, so they order the places too. The longest length is one at which all differ.
    """

    def __init__(self, ids: np.ndarray) -> None:
        n = np.bincount(ids)
        self.ranks = [(np.cumsum(n) - n)[ids]]
        tied = np.flatnonzero(n[ids] > 1)
        self.lengths = [1]
        while len(tied):
            h, old = self.lengths[-1], self.ranks[-1]
            first, then = old[tied], old[tied + h]
            order = np.lexsort((then, first))
            tied, first, then = tied[order], first[order], then[order]
            group = np.r_[True, first[1:] != first[:-1]]
            same = np.r_[False, (first[1:] == first[:-1]) & (then[1:] == then[:-1])]
            at = np.arange(len(tied))
            new = old.copy()
            new[tied] = first + np.maximum.accumulate(np.where(same, 0, at)) - np.maximum.accumulate(np.where(group, at, 0))
            self.ranks.append(new)
            self.lengths.append(2 * h)
            tied = tied[same | np.r_[same[1:], False]]

    def tied_at(self, least: int) -> np.ndarray:
        """Places that share their next words with another: ``least`` words, or the next smaller power of two."""
        level = self.ranks[min(least.bit_length() - 1, len(self.ranks) - 1)]
        return np.flatnonzero(np.bincount(level, minlength=len(level))[level] > 1)

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are equal."""
        n = np.zeros(len(a), np.int64)
        for h, rank in zip(self.lengths[::-1], self.ranks[::-1]):
            n += h * (rank[a + n] == rank[b + n])
        return n

    def agree_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b are equal; a < b."""
        n = np.zeros(len(a), np.int64)
        for h, rank in zip(self.lengths[::-1], self.ranks[::-1]):
            there = a - n - h >= 0
            n += h * (there & (rank[np.where(there, a - n - h, 0)] == rank[np.where(there, b - n - h, 1)]))
        return n


def _ranges(depth: list[int]) -> tuple[list[int], list[int]]:
    """For each place its nearest smaller neighbours' places: the last before, the first after. depth[0] is the smallest."""
    before, after, open_ = [0] * len(depth), [len(depth)] * len(depth), [0]
    for k in range(1, len(depth)):
        d = depth[k]
        while depth[open_[-1]] > d:
            after[open_.pop()] = k
        last = open_[-1]
        before[k] = before[last] if last and depth[last] == d else last
        open_.append(k)
    return before, after


def branching_repeats(ranks: _Ranks, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of tandem repeats whose next word breaks them, for periods from least on."""
    tied = ranks.tied_at(least)
    none = np.empty(0, np.int64)
    if not len(tied):
        return none, none
    suffix = tied[np.argsort(ranks.ranks[-1][tied])]
    shared = np.r_[0, ranks.agree(suffix[:-1], suffix[1:])]
    shared[shared < least] = 0
    before, after = (np.array(x) for x in _ranges(shared.tolist()))
    k = np.flatnonzero(shared)
    if not len(k):
        return none, none
    # a node is a range of leaves [low, high) and a depth; each k of it begins a child
    low, high, depth = before[k], after[k], shared[k]
    order = np.lexsort((k, depth, low))
    k, low, high, depth = k[order], low[order], high[order], depth[order]
    new = np.r_[True, (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])]
    node = np.cumsum(new) - 1
    child = np.r_[low[new], k]
    owner = np.r_[np.arange(new.sum()), node]
    order = np.lexsort((child, owner))
    child, owner = child[order], owner[order]
    low, high, depth = low[new][owner], high[new][owner], depth[new][owner]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    end = np.r_[child[1:], 0]
    end[np.r_[first[1:], len(child)] - 1] = high[first]
    size = end - child
    largest = np.lexsort((-size, owner))[first]  # of each node the first of its children by size
    kept = np.ones(len(child), bool)
    kept[largest] = False
    child, end, low, high, depth, size = (x[kept] for x in (child, end, low, high, depth, size))
    leaf = np.repeat(child - np.cumsum(size) + size, size) + np.arange(size.sum())
    child, end, low, high, depth = (np.repeat(x, size) for x in (child, end, low, high, depth))
    place = np.full(len(ranks.ranks[0]), -1)
    place[suffix] = np.arange(len(suffix))
    at = suffix[leaf]
    found = []
    for other, start in ((at + depth, at), (at - depth, at - depth)):
        there = (other >= 0) & (other < len(place))
        x = np.where(there, place[np.where(there, other, 0)], -1)
        hit = (x >= low) & (x < high) & ((x < child) | (x >= end))
        found.append((start[hit], depth[hit]))
    return tuple(np.concatenate(x) for x in zip(*found))


def runs_of(ids: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least ``least`` words, by start, then period.

    ids: words as numbers, small ones; the last word must come nowhere else. Texts that are searched together must
    share no number.
    """
    ranks = _Ranks(ids)
    floor = least // 4 + 1
    start, period = branching_repeats(ranks, floor)
    end = start + 2 * period
    start = start - ranks.agree_before(start, start + period)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)] & (end - start >= least)
    start, end, period = start[new], end[new], period[new]
    for q in range(floor - 1, 0, -1):  # a multiple stood in for these
        may = np.flatnonzero(period % q == 0)
        period[may[ranks.agree(start[may], start[may] + q) >= end[may] - start[may] - q]] = q
    return np.c_[start, end, period]


def _results(texts: list[list[bytes]], least: int) -> Iterator[tuple]:
    """For each text its runs [(start, length, period)] and its words without repetitions."""
    ids, starts = [], [0]
    number = count()
    for w in texts:
        own: defaultdict = defaultdict(number.__next__)
        ids += map(own.__getitem__, w)
        ids.append(next(number))  # ends the text
        starts.append(len(ids))
    found = runs_of(np.array(ids, np.int64), least) if ids else np.empty((0, 3), np.int64)
    dropped = np.zeros(len(ids) + 1, np.int64)
    np.add.at(dropped, found[:, 0] + found[:, 2], 1)
    np.add.at(dropped, found[:, 1], -1)
    dropped = np.cumsum(dropped) > 0
    cuts = np.searchsorted(found[:, 0], starts)
    for i, w in enumerate(texts):
        at = starts[i]
        own = found[cuts[i] : cuts[i + 1]]
        rows = [(s - at, e - s, p) for s, e, p in own.tolist()]
        yield rows, [x for x, gone in zip(w, dropped[at : starts[i + 1] - 1].tolist()) if not gone] if rows else w


def _found(least: int, texts: bool):
    kinds = [pa.int64(), pa.int64(), pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]), pa.string(), pa.string()] + [pa.string()] * texts
    names = ["doc_id", "n_runs", "longest", "runs_sha256", "collapsed_sha256"] + ["collapsed"] * texts

    def row(doc_id, runs: list[tuple], kept: list[bytes]) -> tuple:
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        told, text = "".join(f"{s},{n},{p}\n" for s, n, p in runs), b" ".join(kept)
        out = (doc_id, len(runs), best and dict(zip(("start", "length", "period"), best)), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
        return (*out, text.decode()) if texts else out

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[list[bytes]] = []
        size = 0

        def done() -> pa.RecordBatch:
            rows = [row(d, *x) for d, x in zip(ids, _results(held, least))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                w = (text.as_py() or "").encode().split()
                if held and size + len(w) > BLOCK_WORDS:
                    yield done()
                    ids, held, size = [], [], 0
                ids.append(doc_id.as_py())
                held.append(w)
                size += len(w) + 1
        if held:
            yield done()

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, texts: bool = False) -> DataFrame:
    """(doc_id, n_runs, longest struct<start, length, period>, runs_sha256, collapsed_sha256), a row for each row of docs.

    A run is a stretch of at least ``least`` words and two of its smallest period, which no neighbour extends. longest: ties
    go to the smallest start, then period; null without a run. runs_sha256 hashes ``start,length,period`` and a line end for each
    run; collapsed_sha256 the words, joined by blanks, that no run has after its first period. texts: that text too, as
    ``collapsed``. Null and empty texts have no words and the hash of nothing; repeated rows are rows each; an empty table
    gives no rows. Other columns are left alone, whatever their names.
    """
    kinds = "doc_id long, n_runs long, longest struct<start: long, length: long, period: long>, runs_sha256 string, collapsed_sha256 string" + ", collapsed string" * texts
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_found(least, texts), kinds)


def echoed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the end of every tenth text, by the CRC of its id, made periodic from a word on.

    With h that CRC, g = floor(h / 10) and n words: from word g % n on, the period is 1 + floor((n - start) / (3 + g % 8)).
    Rows of a null id, and texts without words, stay as they are.
    """
    words, g, start, period = (fresh(docs, x) for x in ("_words", "_g", "_start", "_period"))
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.withColumn(words, F.when(crc % 10 == 0, F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)))).withColumn(g, F.floor(crc / 10).cast("long"))
    n = F.size(words).cast("long")
    rows = rows.withColumn(start, F.when(n > 0, F.col(g) % n))
    rows = rows.withColumn(period, 1 + F.floor((n - F.col(start)) / (3 + F.col(g) % 8)).cast("long"))
    at = lambda i: (F.col(start) + (i - F.col(start)) % F.col(period)).cast("int")
    tail = F.transform(F.sequence(F.col(start), n - 1), lambda i: F.get(F.col(words), at(i)))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), F.col(start).cast("int")), tail), " ")
    return rows.withColumn(text_col, F.when(F.col(start).isNotNull(), made).otherwise(F.col(text_col))).drop(words, g, start, period)
