import duckdb
import numpy as np
import xxhash
from tilesmith.llm import simhash
from tilesmith.llm.registry import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fp(text):
    w = [x for x in (text or "").encode().lower().translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if x]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_groups(rows):
    fp = {i: brute_fp(t) for i, t in rows}
    at = {f: f for f in fp.values()}

    def up(x):
        while at[x] != x:
            x = at[x]
        return x

    keys = list(at)
    arr = np.array(keys, np.uint64)
    for k, x in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(arr ^ np.uint64(x)) <= 3):
            at[up(keys[j])] = up(x)
    least = {}
    for i, f in fp.items():
        least[up(f)] = min(i, least.get(up(f), i))
    return {i: (f"{f:016x}", least[up(f)]) for i, f in fp.items()}


def test_query_equals_brute_force(spark, sf):
    rows = duckdb.connect().execute(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash_bk_trees"](spark, sf).collect()}
    assert got == brute_groups(rows)


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, None, "en", "s", 0), (7, "", None, None, None), (9, " \n\t", "en", "s", 3), (3, text, "en", "s", 1), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (1, "a", "en", "s", 1), (4, " ".join(f"v{i}" for i in range(9000)), "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_groups({(r[0], r[1]) for r in rows})
    got = simhash.simhash_groups(df).collect()
    assert len(got) == len(rows)
    assert all((f"{r.fp % 2**64:016x}", r.component_id) == want[r.doc_id] for r in got)
    kept = simhash.near_deduplicated(df.withColumn("fp", df.doc_id), k=3, similarity=None)
    assert kept.columns == [*df.columns, "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]
    assert simhash.near_deduplicated(df.limit(0), similarity=None).count() == 0


def test_forest_finds_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    fp = np.unique(np.concatenate([base] + [base ^ (np.int64(1) << rng.integers(0, 62, 40)) for _ in range(20)]))
    shard = rng.integers(0, 3, len(fp))
    a, b = simhash.shard_links(shard, fp, 3)
    root = dict(zip(a.tolist(), b.tolist()))
    for s in range(3):
        own = np.sort(fp[shard == s])
        at = {int(x): int(x) for x in own}
        changed = True
        while changed:
            changed = False
            for x in own:
                for y in own[np.bitwise_count((own ^ x).view(np.uint64)) <= 3]:
                    m = min(at[int(x)], at[int(y)])
                    changed |= at[int(x)] != m or at[int(y)] != m
                    at[int(x)] = at[int(y)] = m
        assert len({int(x) for x in own}) == len(own)
        for x in own:
            if (shard[fp == x] == s).all():
                assert root.get(int(x), int(x)) == at[int(x)]


def test_hot_shards_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_MOST", 20)
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 2**20, 400)}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(fps))], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.near_groups(df).collect()}
    keys = sorted(fps)
    at = {x: i for i, x in enumerate(keys)}
    changed = True
    while changed:
        changed = False
        for x in keys:
            m = min(at[y] for y in keys if bin(x ^ y).count("1") <= 3)
            changed |= m != at[x]
            at[x] = m
    assert got == at
