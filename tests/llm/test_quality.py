import zlib

import numpy as np
from tilesmith.llm import quality
from tilesmith.llm.registry import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op5_quality_pu"](spark, sf).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p for q, p in held if q]) > 0.95
    assert np.mean([p for q, p in held if not q]) < 0.2


def test_held_out_labels_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = (sorted(quality.scored(docs.drop("lang", "source"), x).collect()) for x in (labels, turned))
    assert a == b


def test_edges(spark):
    junk, fine = "AAA!! BBB!! CCC!! " * 20, "This is a plain line of words that mean little. "
    rows = [(None, None), (1, ""), (2, " "), (3, "x" * 300_000), (4, junk), (4, fine), (5, fine), (5, fine)] + [(10 + i, f"{fine} {i} " * (1 + i % 7)) for i in range(300)] + [(600 + i, junk * (1 + i % 7) + str(i)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as features", "0 as quality", "1 as score", "2 as text_hash")
    labels = spark.createDataFrame([(10 + i, 1) for i in range(300)] + [(600 + i, 0) for i in range(100)] + [(None, 1), (10, None), (10, 0)], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(np.isfinite(r.score) for r in got)
    assert {r.score for r in got if r.doc_id is None} == {r.score for r in got if r.doc_id in (1, 2)}
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert [r.text for r in kept.where("doc_id = 4").collect()] == [fine]
    assert kept.where("doc_id = 5").count() == 2 and kept.where("doc_id >= 600").count() == 0
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_order_of_rows_tells_little():
    """The texts of test_edges in six orders: what resembles the trusted texts but for a digit is kept, junk is not."""
    junk, fine = "AAA!! BBB!! CCC!! " * 20, "This is a plain line of words that mean little. "
    texts = [fine, fine, fine, junk, "", "x" * 3000] + [f"{fine} {i} " * (1 + i % 7) for i in range(300)] + [junk * (1 + i % 7) + str(i) for i in range(100)]
    x = np.stack([quality.features(t) for t in texts])
    fold = np.array([zlib.crc32(t.encode()) % quality.FOLDS for t in texts])
    good = np.array([6 <= i < 306 for i in range(len(texts))])
    for seed in range(6):
        o = np.random.default_rng(seed).permutation(len(x))
        own = o[good[o]]
        model = quality.Folds(x[own], x[o], fold[own], fold[o], x.mean(0), x.std(0))
        s = model.scores(x, fold)
        assert s[:3].min() > 0.4 and s[3] < 0.1 and s[306:].max() < 0.1 and s[good].min() > 0.8, (seed, s[:6])


def brute_scores(x, fold, good, held):
    """The classifier on all rows, without Spark: both halves' networks on all features."""
    mean, scale = x.astype(np.float64).mean(0), x.astype(np.float64).std(0)
    return quality.Folds(x[good & ~held], x[~held], fold[good & ~held], fold[~held], mean, scale).scores(x, fold)


def test_query_equals_a_fit_without_spark(spark):
    """Features, halves, hold-out and scores of the query against a fit on the driver's copy of all rows (samples hold them all)."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "xxhash64(text) as h", "xxhash64(17, doc_id, xxhash64(text), -1L) >>> 11 as place").orderBy("place").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    x = np.stack([quality.features(r.text) for r in docs])
    fold = np.where(x[:, 0] > 0, [r.h % quality.FOLDS for r in docs], 0)
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs])
    want = brute_scores(x, fold, np.array([labels.get(r.doc_id) == 1 for r in docs]), held)
    got = {r.doc_id: r for r in QUERIES["op5_quality_pu"](spark, sf).collect()}
    assert len(got) == len(docs)
    assert np.allclose([got[r.doc_id].score for r in docs], want, atol=1e-3)
    assert [got[r.doc_id].held_out for r in docs] == held.tolist()


def test_the_risks_gradient(monkeypatch):
    rng = np.random.default_rng(5)
    p, u = rng.normal(0.5, 1, (30, 4)), rng.normal(0, 1, (50, 4))
    signs = set()
    for prior, shift in ((0.3, 0.0), (0.9, 3.0), (0.9, -3.0), (0.5, 0.5)):
        w = [rng.normal(0, 1, (4, 3)), rng.normal(0, 1, 3), rng.normal(0, 1, 3), np.array([shift])]
        p2, u2 = p, u
        if shift > 1:  # where positives have the higher logits, the inner term is below 0
            z = np.tanh(np.concatenate([p, u]) @ w[0] + w[1]) @ w[2]
            order = np.argsort(z)
            p2, u2 = np.concatenate([p, u])[order[50:]], np.concatenate([p, u])[order[:50]]
        _, inner, grads = quality.risk(w, p2, u2, prior)
        signs.add(inner >= 0)
        aim = (lambda: quality.risk(w, p2, u2, prior)[0]) if inner >= 0 else (lambda: -quality.risk(w, p2, u2, prior)[1])
        for x, g in zip(w, grads):
            for i in np.ndindex(x.shape):
                old, e = x[i], 1e-6
                x[i] = old + e
                up = aim()
                x[i] = old - e
                low = aim()
                x[i] = old
                assert abs((up - low) / (2 * e) - g[i]) < 1e-5
    assert signs == {True, False}


def test_the_prior_is_found_without_negative_labels():
    rng = np.random.default_rng(2)
    for prior in (0.2, 0.5, 0.8):
        n = 4000
        good = rng.random(n) < prior
        web = rng.normal(np.where(good, 3.0, -3.0)[:, None], 1, (n, 5))
        trusted = rng.normal(3.0, 1, (1500, 5))
        assert abs(quality.estimated_prior(trusted, web, web.mean(0), web.std(0)) - prior) < 0.08


def test_repeated_rows_do_not_fill_the_sample(spark):
    docs = spark.range(60_000).selectExpr("7L as doc_id", "'the very same text' as text").unionByName(spark.range(1000).selectExpr("id + 100 as doc_id", "concat('a text of its own ', id) as text"))
    rows = quality.featured(docs)
    same = spark.sql("select 1").count() and rows.where("doc_id = 7").first()["features"]
    got, fold = quality._sample(rows, 10_000)
    assert len(fold) == len(got) and set(fold.tolist()) == set(range(quality.FOLDS))
    assert abs(len(got) - (got == np.array(same, np.float32)).all(1).sum() - 10_000 / 61) < 50
