"""Target-distribution importance resampling over hashed features.

A feature is a run of one to ``most_words`` consecutive words; its bucket is the CRC of its bytes. The corpus and
the target text each give a total for every bucket, a bucket's gain is the logarithm of the ratio of the two
smoothed shares, and a document's weight is the mean gain of its features. Gumbel noise that only the document's id
decides turns "the highest scores" into a draw without replacement in proportion to the exponential weights.

Each task keeps the words that it meets in a trie: a node is a run, holds how often it came and the CRC state of its bytes,
and a longer run goes on from the state of the shorter one. A trie that grows past MOST_NODES is folded into the task's
bucket totals and begun anew, so a task holds the trie, one total for each bucket and a batch of texts. Only bucket
totals are shuffled. Scoring walks the same tries with gains attached to the nodes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilesmith.llm.common import dropped, fresh, released, small, written
from tilesmith.llm.decontam import words

BUCKETS = 10_000
#: Nodes of a task's trie.
MOST_NODES = 300_000
#: Documents of fewer words are not drawn.
MIN_WORDS = 20
SHARE_PERCENT = 10
SEED = 2024


class _Node:
    __slots__ = ("children", "count", "crc", "gain")

    def __init__(self, crc: int, gain: int) -> None:
        self.children: dict[bytes, _Node] | None = None
        self.count, self.crc, self.gain = 0, crc, gain


class _Trie:
    """Runs of words as paths. gains: one for each bucket, attached to nodes as they are made."""

    def __init__(self, buckets: int, gains: list[int] | None = None) -> None:
        self.buckets, self.gains = buckets, gains or [0] * buckets
        self.root, self.size = _Node(0, 0), 0

    def node(self, path: tuple[bytes, ...]) -> _Node:
        at = self.root
        for word in path:
            if at.children is None:
                at.children = {}
            below = at.children.get(word)
            if below is None:
                crc = crc32(word if at is self.root else b" " + word, at.crc)
                below = at.children[word] = _Node(crc, self.gains[crc % self.buckets])
                self.size += 1
            at = below
        return at

    def fold(self, totals: np.ndarray) -> None:
        """Add each node's count to its bucket, and forget all nodes."""
        level = [self.root]
        while level:
            level = list(chain.from_iterable(x.children.values() for x in level if x.children))
            np.add.at(totals, [x.crc % self.buckets for x in level], [x.count for x in level])
        self.root, self.size = _Node(0, 0), 0


def _paths(w: list[bytes], most_words: int) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """Distinct runs of one to most_words words, with how often each comes."""
    for k in range(1, most_words + 1):
        yield from Counter(zip(*(w[i:] for i in range(k)))).items()


def _counted(most_words: int, buckets: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = _Trie(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for path, n in _paths(words(text.as_py()), most_words):
                    trie.node(path).count += n
                if trie.size > MOST_NODES:
                    trie.fold(totals)
        trie.fold(totals)
        full = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(totals[full])], ["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, text_col: str = "text", most_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features in each bucket that has any. A task sends at most a row for each bucket."""
    return texts.select(F.col(text_col)).mapInArrow(_counted(most_words, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", most_words: int = 1, buckets: int = BUCKETS) -> list[int]:
    """A gain for each bucket: floor of 1000 times the log of the smoothed shares' ratio. The list's length is a parameter."""
    spark = docs.sparkSession
    both = bucket_totals(docs, text_col, most_words, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.union(bucket_totals(target, text_col, most_words, buckets).select("bucket", F.lit(0).cast("long"), "n"))
    both = both.union(spark.range(buckets).select("id", F.lit(0).cast("long"), F.lit(0).cast("long"))).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    both = written(both, "buckets")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    share = ((F.col("t") + 1).cast("double") * float(all_s + buckets)) / ((F.col("s") + 1).cast("double") * float(all_t + buckets))
    found = [r[0] for r in both.orderBy("bucket").select(F.floor(1000 * F.log(share)).cast("long")).collect()]
    dropped(both)
    return found


def _weighed(most_words: int, buckets: int, gain: list[int]):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _Trie(buckets, gain)
        for batch in batches:
            out = []
            for text in batch.column(1):
                w = words(text.as_py())
                n = sum(max(0, len(w) - k) for k in range(most_words))
                out.append((len(w), n, sum(trie.node(path).gain * c for path, c in _paths(w, most_words)) // n if n else 0))
                if trie.size > MOST_NODES:
                    trie = _Trie(buckets, gain)
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(seed: int, doc_id: str) -> F.Column:
    """1000 times standard Gumbel noise, floored, that seed and id decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with rank long from 1: one order over all partitions, without a task that sees them all.

    Ranges of the order are sorted and numbered on their own, and what comes before a range is a sum over ranges.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    at = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("at", 33)
    parts = at.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = at.join(small(written(parts, "parts")), part == F.col("part"))
    return placed.withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1)


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = SHARE_PERCENT, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), a row for each row of docs.

    rank: 1, 2, 3... for the drawn, by score, ties to the smaller id, then to fewer features; null for all others.
    Drawn are the highest floor(percent * N / 100) of the N rows with min_words words. A text without words (null and empty
    ones too) has weight 0. A null id has the noise of an empty one and comes last in ties. Repeated rows count, are
    scored and are drawn as rows each. Without target text gains only tell frequent buckets from rare ones. An empty
    table gives no rows. Other columns are left alone, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(docs, target.select(F.col(text_col).alias("text")), "text", most_words, buckets)
    rows = docs.mapInArrow(_weighed(most_words, buckets, gain), "doc_id long, n_words long, n_features long, weight long")
    rows = written(rows.withColumn("score", F.col("weight") + noise(seed, "doc_id")).withColumn("row", F.monotonically_increasing_id()), "scores")
    # scores are floored thousandths of logarithms: there are as many as their range is wide, however many rows there are
    by_score = written(rows.where(F.col("n_words") >= min_words).groupBy("score").agg(F.count("*").alias("n")), "by_score")
    drawn = percent * (by_score.agg(F.sum("n")).first()[0] or 0) // 100
    above = by_score.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n"))
    cut = above.where(F.col("above") < drawn).agg(F.min("score")).first()[0]
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return rows.select(*out, none)
    likely = (F.col("n_words") >= min_words) & (F.col("score") >= cut)
    ranked = _ranked(rows.where(likely)).select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.union(rows.where(~likely).select(*out, none))


def sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The drawn documents, all their columns. Of rows that share an id, all stay if one is drawn; a null id is never drawn."""
    own = fresh(docs, "_drawn")
    drawn = resampled(docs, target, id_col, **settings).where("rank is not null and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(small(written(drawn, "drawn")), F.col(id_col).cast("long") == F.col(own), "leftsemi")


#: CRC by its table, byte by byte over the distinct words. Each floor and logarithm is one of doubles.
SQL = f"""
WITH tbl AS (SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS crcs),
texts AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
aims AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
own AS (SELECT rid, unnest(words) AS word FROM texts),
theirs AS (SELECT unnest(words) AS word FROM aims),
lexicon AS (SELECT DISTINCT word FROM (SELECT word FROM own UNION ALL SELECT word FROM theirs)),
crcs AS (SELECT word, xor(4294967295, list_reduce(list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295)) % {BUCKETS} AS bucket FROM lexicon, tbl),
s AS (SELECT bucket, count(*) AS n FROM own JOIN crcs USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM theirs JOIN crcs USING (word) GROUP BY bucket),
gain AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
),
weights AS (SELECT rid, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN crcs USING (word) JOIN gain USING (bucket) GROUP BY rid),
scores AS (
  SELECT doc_id, rid, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (rid)
),
ranks AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM scores WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {SHARE_PERCENT} * n // 100 THEN rank END AS rank FROM scores LEFT JOIN ranks USING (rid)
"""
