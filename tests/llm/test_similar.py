import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tilesmith.llm import simhash


def brute(rows, k=5, similarity=0.8):
    sets = {i: simhash.shingles(t, k) for i, t in rows}
    at = {i: i for i in sets}

    def up(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in similar_pairs(sets, similarity):
        at[max(up(a), up(b))] = min(up(a), up(b))
    return {i: up(i) for i in sets}


def similar_pairs(sets, similarity=0.8):
    post = {}
    for i, s in sets.items():
        for x in s or {None}:
            post.setdefault(x, []).append(i)
    seen = {(a, b) for own in post.values() for a in own for b in own if a < b}
    for a, b in seen:
        x, y = sets[a], sets[b]
        if not x and not y or x | y and len(x & y) >= similarity * len(x | y):
            yield a, b


def varied(rng, words, share):
    return [f"v{rng.random()}" if rng.random() < share else w for w in words]


def groups(df, **more):
    return {r.doc_id: r.component_id for r in simhash.similar_groups(df, **more).collect()}


def test_planted_copies_are_found(spark):
    rng = random.Random(4)
    rows = []
    for g in range(300):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((8, 40, 120, 400)))]
        rows.append((3 * g, " ".join(base)))
        rows.append((3 * g + 1, " ".join(varied(rng, base, rng.choice((0.005, 0.01, 0.02, 0.03))))))
        rows.append((3 * g + 2, " ".join(varied(rng, base, 0.5))))
    want = brute(rows)
    assert sum(want[i] != i for i in want) > 150
    assert groups(spark.createDataFrame(rows, "doc_id long, text string")) == want


def clusters(n, seed=6):
    """Families of which many pairs lie just above or below the limit."""
    rng, rows = random.Random(seed), []
    for g in range(n):
        base = [f"g{g}w{i}" for i in range(60)]
        for i in range(6):
            own = list(base)
            for j in rng.sample(range(60), rng.randrange(4)):
                own[j] = f"v{rng.random()}"
            rows.append((6 * g + i, " ".join(own)))
    return rows


def test_recall_of_links_in_clusters_near_the_limit(spark):
    rows = clusters(400)
    got = groups(spark.createDataFrame(rows, "doc_id long, text string"))
    pairs = list(similar_pairs({i: simhash.shingles(t, 5) for i, t in rows}))
    assert len(pairs) > 500
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.999 * len(pairs)
    want = brute(rows)
    assert all(want[got[i]] == want[i] for i in got)  # nothing that isn't similar is linked


def test_bands_reach_their_recall_and_the_radius_holds_pairs_at_the_limit():
    n = simhash._bands(0.8)
    assert 1 - (1 - 0.8**simhash.BAND) ** n >= 0.999
    factors, rng = simhash._factors(n * simhash.BAND, 0), np.random.default_rng(1)
    met = near = 0
    sizes = [(4, 0, 1), (8, 1, 1), (40, 5, 5), (400, 50, 50), (400, 0, 100)]
    for i in range(2000):
        both, a, b = sizes[i % len(sizes)]
        x = rng.integers(0, 1 << 63, both + a + b).astype(np.uint64)
        one, two = np.sort(x[: both + a]), np.sort(np.r_[x[:both], x[both + a :]])
        met += bool((simhash.band_keys(one, factors) == simhash.band_keys(two, factors)).any())
        d = simhash.wide_fingerprint(one).view(np.uint64) ^ simhash.wide_fingerprint(two).view(np.uint64)
        near += int(np.bitwise_count(d).sum()) <= simhash._radius(0.8)
    assert met >= 0.997 * 2000 and near >= 0.999 * 2000


def test_spanning_forest_keeps_the_components_of_every_distance():
    rng = np.random.default_rng(3)
    a, b, d = rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(0, 9, 400)
    fa, fb, fd = simhash._spanning(60, a, b, d)
    assert len(fa) < 60

    def parts(x, y):
        parent = np.arange(60)
        simhash._joined(parent, x, y)
        for _ in range(10):
            parent = parent[parent]
        return parent.tolist()

    for most in range(9):
        assert parts(a[d <= most], b[d <= most]) == parts(fa[fd <= most], fb[fd <= most])


@pytest.mark.parametrize("most", [8192, 3])
def test_edges(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "SHARD_MOST", most)
    words = [f"w{i}" for i in range(200)]
    near = [" ".join(words[:j] + ["other"] + words[j + 1 :]) for j in range(20, 180, 10)]
    rows = [(None, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  TWO"), (5, " ".join(words)), (5, " ".join(words)), (6, " ".join(f"x{i}" for i in range(60_000)))] + [(10 + i, t) for i, t in enumerate(near)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as f0", "3 as shard", "4 as least", "5 as a", "6 as hash", "7 as root")
    assert groups(df) == {None: 1, 1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6} | {10 + i: 5 for i in range(len(near))}
    kept = simhash.near_deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6]
    assert simhash.near_deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("similarity", [0.8, None])
def test_rows_are_judged_and_not_ids(spark, similarity):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, b), (None, c), (None, c), (None, a), (9, None), (9, ""), (None, None)]
    kept = simhash.near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity).collect()
    assert sorted(((r.doc_id, r.text) for r in kept if r.text), key=str) == sorted([(1, a), (5, b), (None, c)], key=str)
    assert [r.doc_id for r in kept if not r.text] == [9]


@pytest.mark.parametrize("most,deeper", [(8192, 2), (20, 2), (20, 0)])
def test_families_around_the_limit_have_all_their_links(spark, monkeypatch, most, deeper):
    """One shard and no radius leave nothing to chance: a checked pair that fails must not hide another, in hot shards too."""
    monkeypatch.setattr(simhash, "SHARD_MOST", most)
    monkeypatch.setattr(simhash, "DEEPER", deeper)
    monkeypatch.setattr(simhash, "_radius", lambda similarity: simhash.WIDE)
    if not deeper or most > 20:
        whole = simhash.described
        monkeypatch.setattr(simhash, "described", lambda *x: whole(*x).withColumn("bands", F.array(F.lit(1).cast("long"))))
    rng = random.Random(6)
    rows = []
    for g, n in enumerate((30, 80, 200)):
        base = [f"g{g}w{i}" for i in range(120)]
        rows += [(1000 * g + i, " ".join(varied(rng, base, 0.03))) for i in range(n)]
    want = brute(rows)
    assert 30 < len(set(want.values())) < len(rows) - 30
    assert groups(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_groups_of_a_whole_table_equal_brute_force(spark):
    """All 10,000 documents of sf0.1: every pair at 0.8 is sought by the rarest shingles of both, which such a pair must share."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    by_set = {}
    for r in docs.collect():
        by_set.setdefault(frozenset(simhash.shingles(r.text, 5)), []).append(r.doc_id)
    sets = {min(ids): s for s, ids in by_set.items()}
    count = {}
    for s in sets.values():
        for x in s:
            count[x] = count.get(x, 0) + 1
    post, at, n_pairs = {}, {i: i for i in sets}, 0

    def up(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, s in sorted(sets.items()):
        rare = sorted(s, key=lambda x: (count[x], x))[: len(s) - math.ceil(0.8 * len(s)) + 1]
        for j in {j for x in rare for j in post.get(x, ())}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                n_pairs += 1
                a, b = up(i), up(j)
                at[max(a, b)] = min(a, b)
        for x in rare:
            post.setdefault(x, []).append(i)
    assert n_pairs >= 48
    want = {d: up(min(ids)) for ids in by_set.values() for d in ids}
    assert groups(docs) == want
