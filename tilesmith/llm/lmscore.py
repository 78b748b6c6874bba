"""LM scoring by cross-entropy difference.

Two interpolated bigram models, one of target text and one of matched background text, share one
vocabulary: all words of the corpus. A document's score is the mean over its tokens of the background's loss less the
target's, so that text like the target's scores high. Nothing is pruned, and each document is left out of the
counts that score it, so a text's own n-grams tell nothing, and those of its copies do.

Texts are cut into tokens once and stored by block of documents. Each block sends its distinct n-grams (as 64-bit
hashes) with their counts, sorted and packed by ranges of hashes; the ranges meet by a shuffle, each n-gram is summed over
all blocks once, and the sums go back to the blocks that asked, in the order in which they came. So the model grows with the
corpus, is spread over all tasks, and never passes through the driver; a task holds a block, or a range of about RANGE_TOKENS
tokens' n-grams. An n-gram comes once a block however often it occurs.

Matched: background counts are scaled, language by language, to the target's share of
bytes in that language, so the difference tells domains apart and not languages. Weights are multiples of 1 / SCALE, so that
sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilesmith.llm.common import fresh, released, small, trim, written
from tilesmith.llm.decontam import words

#: Weight of the bigram estimate against the unigram's.
BIGRAM = 0.7
#: Characters of documents whose n-grams are summed before they are sent.
BLOCK_CHARS = 32 << 20
#: Tokens whose n-grams make up a range of hashes, on average.
RANGE_TOKENS = 1 << 19
#: Tokens of whole documents scored at once.
SLICE_TOKENS = 1 << 18
SCALE = 1024
#: Stands before a text's first word.
START = np.uint64(0x2545F4914F6CDD1C)


def _planes(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes: the upper ones are nearly empty."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _unplanes(x: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


BLOCK = "block long, ids array<long>, target array<boolean>, weight array<long>, counts array<int>, numbers binary, hashes binary, t long, b long"


@released
def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its documents, their tokens as numbers of its words, and the words' hashes."""
    from pyspark import TaskContext

    names = [x.split(" ")[0] for x in BLOCK.split(", ")]
    part, made = TaskContext.get().partitionId(), 0
    numbers: dict[bytes, int] = {}
    rows: list[tuple] = []
    tokens: list[np.ndarray] = []
    size = 0

    def row() -> pa.RecordBatch:
        ids, target, weight = (list(c) for c in zip(*rows))
        counts = np.array([len(x) for x in tokens], np.int64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        own = np.array(target, bool)
        t, b = int(counts[own].sum()), int((counts * np.array(weight, np.int64))[~own].sum())
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        values = ((part << 32) + made, ids, target, weight, counts.tolist(), _planes(np.concatenate(tokens)), hashes.tobytes(), t, b)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        for doc_id, target, weight, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            text = text.as_py()
            w = words(text)
            for x in w:
                numbers.setdefault(x, len(numbers))
            rows.append((doc_id, target, weight))
            tokens.append(np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)))
            size += len(text or "") + 64
            if size >= BLOCK_CHARS:
                yield row()
                numbers, rows, tokens, size, made = {}, [], [], 0, made + 1
    if rows:
        yield row()


class _Block:
    """N-grams of a block: its words, the start mark, and its pairs of neighbours, numbered in order of their hashes."""

    def __init__(self, counts: np.ndarray, numbers: bytes, hashes: bytes) -> None:
        self.counts, self.tokens = counts.astype(np.int64), _unplanes(numbers, "<i4")
        h = np.r_[np.frombuffer(hashes, np.uint64), START]
        n = len(h)
        full = self.counts > 0
        self.first = (np.cumsum(self.counts) - self.counts)[full]
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.first] = n - 1
        pairs, self.pair = np.unique(self.before.astype(np.int64) * n + self.tokens, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        both = h[pairs // n] * np.uint64(0x9E3779B97F4A7C15) + h[pairs % n]
        both = (both ^ (both >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.keys = np.r_[h & ~np.uint64(1), (both ^ (both >> np.uint64(29))) | np.uint64(1)]  # words are even
        self.order = np.argsort(self.keys)
        self.n_words = n

    def sums(self, by_doc: np.ndarray) -> np.ndarray:
        """Of each n-gram, in order of hashes, the sum over its occurrences of their document's number."""
        by_token = np.repeat(by_doc, self.counts).astype(np.float64)
        single = np.bincount(self.tokens, by_token, self.n_words)
        single[-1] = by_doc[self.counts > 0].sum()
        return np.r_[single, np.bincount(self.pair, by_token, len(self.keys) - self.n_words)][self.order].astype(np.int64)


def _blocks(b) -> Iterator[tuple]:
    """(block number, document ids, target, weight, _Block) of the rows of a batch or table."""
    cols = {c: b.column(c) if isinstance(b, pa.Table) else b.column(b.schema.get_field_index(c)) for c in ("block", "ids", "target", "weight", "counts", "numbers", "hashes")}
    for i in range(b.num_rows):
        one = {c: x[i] for c, x in cols.items()}
        target = one["target"].values.to_numpy(zero_copy_only=False).astype(bool)
        yield one["block"].as_py(), one["ids"].values, target, one["weight"].values.to_numpy(), _Block(one["counts"].values.to_numpy(), one["numbers"].as_py(), one["hashes"].as_py())


def _gram_rows(bits: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "block", "keys", "t", "b"]
        for batch in batches:
            for block, _, target, weight, x in _blocks(batch):
                keys, t, b = x.keys[x.order], x.sums(target.astype(np.int64)), x.sums(np.where(target, 0, weight))
                del x
                part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                ends = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
                rows = [(int(part[i]), block, _planes(np.diff(keys[i:j], prepend=np.uint64(0))), _planes(t[i:j]), _planes(b[i:j])) for i, j in zip(ends, ends[1:])]
                for i in range(0, len(rows), 1000):
                    cols = list(zip(*rows[i : i + 1000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names)

    return run


def _summed(table: pa.Table) -> pa.Table:
    """The sums over all blocks of a range's n-grams, as each block asked for them."""
    trim()
    keys = [np.cumsum(_unplanes(x.as_py(), "<u8"), dtype=np.uint64) for x in table["keys"]]
    ends = np.cumsum([len(x) for x in keys])
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([_unplanes(x.as_py(), "<i8") for x in table[c]]), len(own)).astype(np.int64) for c in ("t", "b")]
    back = [[_planes(s[at[e - len(k) : e]]) for k, e in zip(keys, ends)] for s in sums]
    n_words = [int((own & np.uint64(1) == 0).sum())] + [0] * (len(keys) - 1)
    return pa.table({"block": table["block"], "part": table["part"], "t": pa.array(back[0], pa.binary()), "b": pa.array(back[1], pa.binary()), "n_words": pa.array(n_words, pa.int64())})


def _own_counts(doc: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """How often each value occurs in its document."""
    _, at, count = np.unique(doc * n + x, return_inverse=True, return_counts=True)
    return count[at]


def _losses(x: _Block, at: int, to: int, docs: np.ndarray, sums: np.ndarray, total: int, size: int, left_out: np.ndarray, own: tuple) -> np.ndarray:
    """Loss of each token from at to to, by the counts less those of its own document times left_out."""
    w, b, p = x.tokens[at:to], x.before[at:to], x.pair[at:to]
    own_w, own_b, own_p = own
    f = left_out[docs].astype(np.float64)
    single = (sums[w] - f * own_w + SCALE) / (total - f * x.counts[docs] + SCALE * size)
    first = sums[b] - f * own_b
    pair = (sums[x.n_words + p] - f * own_p) / np.maximum(first, 1)
    return -np.log(np.where(first > 0, (1 - BIGRAM) * single + BIGRAM * pair, single))


SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _scores(size: int, all_t: int, all_b: int):
    def run(places: pa.Table, totals: pa.Table) -> pa.Table:
        trim()
        out = []
        totals = totals.sort_by("part")
        for _, ids, target, weight, x in _blocks(places):
            sums = []
            for c, scale in (("t", SCALE), ("b", 1)):
                own = np.empty(len(x.keys), np.int64)
                own[x.order] = np.concatenate([_unplanes(v.as_py(), "<i8") for v in totals[c]]) * scale
                sums.append(own)
            out_of = (np.where(target, SCALE, 0), np.where(target, 0, weight))
            loss = np.zeros((len(x.counts), 2))
            ends = np.cumsum(x.counts)
            d = 0
            while d < len(ends):
                at = int(ends[d] - x.counts[d])
                e = max(d + 1, int(np.searchsorted(ends, at + SLICE_TOKENS, "right")))
                to = int(ends[e - 1])
                if to > at:
                    docs = np.repeat(np.arange(d, e), x.counts[d:e])
                    own_w = _own_counts(docs, x.tokens[at:to], x.n_words)
                    own_b = np.r_[1, own_w[:-1]]
                    own_b[x.before[at:to] == x.n_words - 1] = 1
                    own = (own_w, own_b, _own_counts(docs, x.pair[at:to], len(x.keys)))
                    for c, total in enumerate((all_t * SCALE, all_b)):
                        loss[d:e, c] = np.bincount(docs - d, _losses(x, at, to, docs, sums[c], total, size, out_of[c], own), e - d)
                d = e
            loss /= np.maximum(x.counts, 1)[:, None]
            out.append(pa.table({"doc_id": ids, "n_tokens": pa.array(x.counts), "target_loss": pa.array(loss[:, 0].copy()), "background_loss": pa.array(loss[:, 1].copy()), "score": pa.array(loss[:, 1] - loss[:, 0])}))
        return pa.concat_tables(out)

    return run


def matched(docs: DataFrame, target: str, lang: str, text_col: str) -> DataFrame:
    """(doc_id, target, weight long, text): weights, in 1 / SCALE, match the background's languages to the target's."""
    rows = docs.select("doc_id", F.col(target).alias("target"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("double")
    by_lang = rows.groupBy("lang").agg(F.sum(F.when(F.col("target"), size)).alias("t"), F.sum(F.when(~F.col("target"), size)).alias("b"))
    by_lang = written(by_lang, "langs")
    all_t, all_b = (x or 0.0 for x in by_lang.agg(F.sum("t"), F.sum("b")).first())
    weight = F.when(F.col("b") > 0, F.coalesce("t", F.lit(0.0)) / all_t * all_b / F.col("b")).otherwise(1.0) if all_t else F.lit(1.0)
    weights = small(by_lang.select(F.col("lang").alias("_lang"), F.round(weight * SCALE).cast("long").alias("weight")))
    return rows.join(weights, F.col("lang") == F.col("_lang")).select("doc_id", "target", "weight", "text")


def scored(docs: DataFrame, target: Column, id_col: str = "doc_id", lang: str = "lang", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score), a row for each row of docs.

    Losses are means in nats a token by the counts of all other rows; score = background_loss - target_loss. A text without
    words (null and empty ones too) has losses and score 0. A null ``target`` is background, a null
    language one of its own. Repeated rows count and score as rows each, so each is scored by its copies; an empty table gives
    no rows. Words and pairs of one 64-bit hash would count as one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(target, F.lit(False)).alias("target"), F.col(lang).alias("lang"), F.col(text_col).alias("text"))
    places = written(matched(rows, "target", "lang", "text").mapInArrow(_token_rows, BLOCK), "tokens")
    all_t, all_b, n = places.agg(F.sum("t"), F.sum("b"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    bits = max(0, ceil(log2(max(1, n or 0) / RANGE_TOKENS)))
    grams = places.mapInArrow(_gram_rows(bits), "part long, block long, keys binary, t binary, b binary")
    totals = written(grams.groupBy("part").applyInArrow(_summed, "block long, part long, t binary, b binary, n_words long"), "totals")
    size = totals.agg(F.sum("n_words")).first()[0] or 0
    return places.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_scores(size, all_t or 0, all_b or 0), SCORES)


def labelled_target(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Column]:
    """docs with a column that marks those labelled good and not toxic, and that column."""
    own = fresh(docs, "_good")
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    good = small(written(good, "good"))
    return docs.join(good, docs["doc_id"] == good[own], "left"), F.col(own).isNotNull()
