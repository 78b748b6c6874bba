import hashlib
import math
import zlib
from collections import Counter

from tests.llm.oracle import same
from tilesmith.llm import importance
from tilesmith.llm.decontam import words
from tilesmith.llm.registry import ORACLE, QUERIES


def test_query_equals_sql(spark, sf):
    rows = same(spark, sf, "op13_importance_tries", QUERIES, ORACLE)
    n = sum(r["n_features"] >= 20 for r in rows)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, n // 10 + 1))


def features(text, most):
    w = words(text)
    return [b" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, most=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in features(t, most))
    s, t = count(x for _, x in docs), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * (big_s + buckets) / (float(s[b] + 1) * (big_t + buckets))))
    rows = []
    for d, x in docs:
        own = features(x, most)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(words(x)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = order[: percent * len(order) // 100]
    out = [(*r, i) for i, r in enumerate(drawn, 1)]
    for r in drawn:
        rows.remove(r)
    return sorted([*out, *((*r, None) for r in rows)], key=str)


ROWS = [(i, f"word{i % 7} some text of number {i} " * (1 + i % 5)) for i in range(60)]
ROWS += [(None, None), (None, "alone here " * 12), (1, ""), (2, "?! ..."), (70, "é日本 " * 30), (71, "w " * 200_000), (72, ROWS[3][1]), (72, ROWS[3][1]), (72, ROWS[4][1]), (73, "a\x00b A_Z ÀB " * 8)]
TARGET = ["number some other target text", None, "", "alone here and there é"]


def test_edges_equal_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as n", "3 as score", "4 as row", "5 as at", "6 as rank").repartition(5)
    target = spark.createDataFrame([(x,) for x in TARGET], "text string").selectExpr("*", "7 as item_id")
    for nodes in (importance.MOST_NODES, 3):
        monkeypatch.setattr(importance, "MOST_NODES", nodes)
        for most, buckets, min_words, percent in ((1, 10_000, 20, 10), (3, 50, 2, 35), (2, 1, 1, 100)):
            got = importance.resampled(docs, target, most_words=most, buckets=buckets, min_words=min_words, percent=percent)
            assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, TARGET, most, buckets, min_words, percent)


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    assert importance.resampled(docs.limit(0), target).count() == 0
    got = importance.resampled(docs, target.limit(0), percent=50)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, [], percent=50)
    assert importance.resampled(docs, target, percent=0).where("rank is not null").count() == 0
    assert importance.resampled(docs, target, min_words=10**9).where("rank is not null").count() == 0


def test_drawn_documents_are_like_the_target(spark):
    rows = [(i, ("gene cell protein cancer tissue " if i % 10 == 0 else "match goal team league score ") * 5 + f"x{i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as _drawn")
    target = spark.createDataFrame([("cell and gene and tissue of cancer",)], "text string")
    got = importance.sample(docs, target)
    assert got.columns == docs.columns and got.count() == 100
    assert got.where("doc_id % 10 = 0").count() > 40  # a tenth of all are like the target
