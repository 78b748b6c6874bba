"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into blocks of whole documents; a block's postings (each term's word
positions, ascending) are stored as rows of a Parquet table, so the index is sharded by document
like a search engine's. A query takes each window of a test item, starts from the term of it that
is rarest in the whole corpus, shifts that term's postings to the window's start and intersects
them with the other terms' postings, each shifted by its own offset, from rare to frequent. Only
terms of the test set are posted, unless these are too many, or a stored index of all terms is given. Postings never meet
in a shuffle by term, so a frequent word is no hot key. The test set's windows, their terms' frequencies and order are tables
too; they go to the tasks in parts of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesmith.llm.common import dropped, released, small, trim, written

WINDOW = 10
#: Extra words between the terms of a window that a proximity match allows.
SLOP = 5
#: Bytes of documents in a block.
BLOCK_BYTES = 10 << 20
#: Bytes of the test set's windows that go to the tasks at once; more go in further parts.
PART_BYTES = 16 << 20
#: Distinct terms of the test set beyond which all terms are posted.
MOST_TERMS = 1_000_000

#: A-Z to a-z, other ASCII that is no digit or letter to a space; all bytes of other letters stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[list[list]]:
    """Rows [first columns ..., text] of whole documents, about ``most`` bytes at a time."""
    held, size = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            held.append(row)
            size += len(row[-1] or "") + 64
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


INDEX = "block string, term binary, doc_id long, hash long, seq int, start long, n_words long, positions array<int>"


def _index(terms):
    from pyspark import TaskContext

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "term", "doc_id", "hash", "seq", "start", "n_words", "positions"]
        for k_block, docs in enumerate(blocks(batches)):
            block = f"{TaskContext.get().partitionId()}-{k_block}"
            vocab: dict[bytes, int] = {t: i for i, t in enumerate(terms.value)} if terms is not None else {}
            starts, counts, ids, at = [], [], [], 0
            for _, _, text in docs:
                w = words(text)
                if terms is None:
                    for x in w:
                        vocab.setdefault(x, len(vocab))
                ids.append(np.fromiter(map(vocab.get, w, [-1] * len(w)), np.int32, len(w)))
                starts.append(at)
                counts.append(len(w))
                at += len(w) + WINDOW + SLOP + 1  # no window or span reaches over a gap
            n = len(docs)
            null = pa.nulls
            yield pa.RecordBatch.from_arrays([pa.array([block] * n), null(n, pa.binary()), pa.array([x[0] for x in docs], pa.int64()), pa.array([x[1] for x in docs], pa.int64()), pa.array(range(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), null(n, pa.list_(pa.int32()))], names)
            flat = np.concatenate(ids)
            place = np.concatenate([np.arange(s, s + c, dtype=np.int32) for s, c in zip(starts, counts)])
            flat, place = flat[flat >= 0], place[flat >= 0]
            order = np.argsort(flat, kind="stable")
            flat, place = flat[order], place[order]
            head = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
            by_id = list(vocab)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[head, len(flat)].astype(np.int32)), pa.array(place))
            m, sizes = len(head), np.diff(np.r_[head, len(flat)]).astype(np.int64)
            for i in range(0, m, 4096):
                k = min(4096, m - i)
                yield pa.RecordBatch.from_arrays([pa.array([block] * k), pa.array([by_id[t] for t in flat[head[i : i + k]]], pa.binary()), null(k, pa.int64()), null(k, pa.int64()), null(k, pa.int32()), null(k, pa.int64()), pa.array(sizes[i : i + k]), lists[i : i + k]], names)

    return run


def positional_index(docs: DataFrame, terms: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: for each block, a row for each document (a hash of its text, its first position and number of
    words) and a row for each term (its positions, and in n_words how many). All terms, or the
    given ones only."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(terms) if terms is not None else None
    return written(rows.mapInArrow(_index(shared), INDEX), "postings")


@released
def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, text in zip(b.column(0).to_pylist(), b.column(1)):
            w = words(text.as_py())
            made = list(dict.fromkeys(tuple(w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1)))) if w else []
            for i in range(0, len(made), 10_000):
                part = made[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.list_(pa.binary()))], ["item", "words"])


def windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, words array<binary>, items array<string>): the distinct windows of the items, numbered, stored."""
    tests = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    rows = tests.mapInArrow(_window_rows, "item string, words array<binary>").groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return written(rows.withColumn("window", F.monotonically_increasing_id()), "windows")


def _ordered(tests: DataFrame, index: DataFrame) -> DataFrame:
    """(terms array<struct<n, term, at>>, items): the windows of which the index holds each term, terms from rarest to most frequent in it."""
    asked = tests.select("window", F.posexplode("words").alias("at", "term"))
    terms = small(written(asked.select("term").distinct(), "terms"))
    n = index.where("term is not null").groupBy("term").agg(F.sum("n_words").alias("n")).join(terms, "term", "left_semi")
    order = asked.join(small(written(n, "frequencies")), "term").groupBy("window").agg(F.sort_array(F.collect_list(F.struct("n", "term", "at"))).alias("terms"))
    return written(tests.join(order, "window").where(F.size("terms") == F.size("words")).select("window", "terms", "items"), "ordered")


def _exact(post: dict[bytes, np.ndarray], terms: list) -> np.ndarray:
    """Starts of a phrase: offset-adjusted intersection."""
    t, o = terms[0]
    at = post[t] - o
    for t, o in terms[1:]:
        if not len(at):
            break
        p = post[t]
        i = np.searchsorted(p, at + o)
        at = at[p[np.minimum(i, len(p) - 1)] == at + o]
    return at


def _near(post: dict[bytes, np.ndarray], terms: list, reach: int) -> np.ndarray:
    """Positions of the rarest term from which every other term lies within reach."""
    at = post[terms[0][0]]
    for t in {t for t, _ in terms[1:]} - {terms[0][0]}:
        if not len(at):
            break
        p = post[t]
        first = p[np.minimum(np.searchsorted(p, at - reach), len(p) - 1)]
        at = at[(first >= at - reach) & (first <= at + reach)]
    return at


MATCHES = "doc_id long, hash long, block string, seq int, n_words long, hit_at array<int>, items array<string>, near_items array<string>"


def _matched(windows):
    def run(table):
        trim()
        own = table.filter(pc.is_null(table["term"])).sort_by("seq")
        rest = table.filter(pc.is_valid(table["term"]))
        lists = rest["positions"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
        values, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
        post = {t: values[a:b] for t, a, b in zip(rest["term"].to_pylist(), ends, ends[1:])}
        starts = own["start"].to_numpy()
        n = len(starts)
        cover: list[set] = [set() for _ in range(n)]
        items: list[set] = [set() for _ in range(n)]
        near: list[set] = [set() for _ in range(n)]
        for terms, names in windows.value:
            length = len(terms)
            if not all(t in post for t, _ in terms):
                continue
            for at in _exact(post, terms).tolist():
                d = int(np.searchsorted(starts, at, "right")) - 1
                items[d].update(names)
                cover[d].update(range(at - starts[d], at - starts[d] + length))
            for d in np.unique(np.searchsorted(starts, _near(post, terms, length - 1 + SLOP), "right") - 1).tolist():
                near[d].update(names)
        return pa.table(
            {
                "doc_id": own["doc_id"], "hash": own["hash"], "block": own["block"], "seq": own["seq"], "n_words": own["n_words"],
                "hit_at": pa.array([sorted(int(x) for x in c) for c in cover], pa.list_(pa.int32())), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "near_items": pa.array([sorted(x) for x in near], pa.list_(pa.string())),
            }
        )

    return run


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: (doc_id, hash, block, seq, n_words, hit_at, items, near_items).

    hash: that of the text. hit_at: the word positions inside any occurrence of a window of WINDOW words of an item (a
    shorter item is one window). items: those items. near_items: items with a window all of whose
    terms lie, in any order, within SLOP extra words of its rarest one; exact matches are near
    too. Null and empty texts have no words and no match, in docs and in items; repeated rows give
    repeated rows; empty tables give no rows or no matches. ``index``: a stored index of docs with all terms, so that
    several test sets can share one.
    """
    spark = docs.sparkSession
    tests = windows(items, item_col, text_col)
    if index is None:
        terms = written(tests.select(F.explode("words").alias("term")).distinct(), "terms")
        few = terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS
        index = positional_index(docs, {bytes(x) for x in terms.toArrow()["term"].to_pylist()} if few else None, id_col, text_col)
        dropped(terms)
    asked = _ordered(tests, index)
    size = tests.agg(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16))).first()[0] or 0
    parts, out = max(1, ceil(size / PART_BYTES)), None
    for i in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == i).select("terms", "items").toArrow().to_pylist()
        part = spark.sparkContext.broadcast([([(bytes(t["term"]), t["at"]) for t in r["terms"]], r["items"]) for r in rows])
        found = index.groupBy("block").applyInArrow(_matched(part), MATCHES)
        out = found if out is None else out.unionByName(found)
    if parts > 1:  # blocks are the same in every part
        out = out.groupBy("block", "seq", "doc_id", "hash", "n_words").agg(*(_union_of(c) for c in ("hit_at", "items", "near_items")))
    for t in (tests, asked):
        dropped(t)
    out._index = index  # may be dropped once the matches are stored
    return out


def _union_of(c: str) -> F.Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows of which any word lies in an occurrence of a test item's window.

    Each row is judged by its own doc_id and text: rows that share an id, or have none, don't go with one another.
    Null and empty texts stay; repeated rows stay or go together; empty tables are no case of their own.
    """
    found = matches(docs, items)
    bad = written(found.where(F.size("hit_at") > 0).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).distinct(), "bad")
    dropped(found._index)
    side = small(bad)
    return docs.join(side, docs["doc_id"].cast("long").eqNullSafe(side["_id"]) & (F.xxhash64(docs["text"]) == side["_hash"]), "left_anti").select(docs.columns)
