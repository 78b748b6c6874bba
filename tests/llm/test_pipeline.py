import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_bpe import ENC
from tests.llm.test_decontam import brute as brute_leaks
from tests.llm.test_similar import brute as brute_groups
from tilesmith.llm import linededup, quality


def brute(spark, docs, sf):
    """docs: rows of documents; the classifier's scores are its own, every decision on them is made again."""
    frame = spark.createDataFrame(docs)
    bad = {(r.doc_id) for r in quality.scored(frame, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.score < 0.3}
    docs = [d for d in docs if d.doc_id not in bad]
    pages, seen = Counter(d.source for d in docs), defaultdict(int)
    for d in docs:
        for line in {x.strip(" ") for x in d.text.split("\n")} - {""}:
            seen[d.source, line] += 1
    gone = {k for k, n in seen.items() if n >= linededup.MIN_PAGES and n > linededup.RATIO * pages[k[0]]}
    texts = {d.doc_id: "\n".join(x for x in d.text.split("\n") if (d.source, x.strip(" ")) not in gone) for d in docs}
    assert gone
    groups = brute_groups(texts.items())
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute_leaks(texts.items(), items) if r[-1]}
    assert hit
    out = []
    for i, t in texts.items():
        if i not in hit:
            ids = ENC.encode_ordinary(t)
            out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == brute(spark, docs, sf)


def test_stages_take_odd_rows(spark, sf):
    odd = [(None, None, None, None, None), (10**6, None, "en", "src0", None), (10**6 + 1, "", None, None, 0), (10**6 + 2, "word " * 60_000, "en", "src1", 300_000), (10**6 + 3, "twice the same row", "en", "src1", 18)]
    base = spark.read.parquet(f"{sf}/documents.parquet")
    docs = base.unionByName(spark.createDataFrame([*odd, odd[-1]], base.schema)).withColumns({c: F.lit(1) for c in ("fp", "host", "_id", "_hash", "_bad", "_host", "_hashes", "_kept", "block", "label")})
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows2 = stage(spark, rows, sf)
            assert rows2.columns == docs.columns, name
            rows = corpus_pipeline.written(rows2, "t")
        got = corpus_pipeline.STAGES[-1][1](spark, rows, sf)
        assert got.count() == rows.count()
    assert corpus_pipeline.STAGES[2][1](spark, docs, sf).where(f"doc_id = {10**6 + 3}").count() == 1


