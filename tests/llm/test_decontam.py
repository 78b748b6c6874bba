import hashlib
import re

import duckdb
from tilesmith.llm import decontam
from tilesmith.llm.registry import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tok(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = tok(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, own = tok(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := wins.get(tuple(w[k : k + n])):
                    own |= got
                    hit |= set(range(k, k + n))
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


def rows(df):
    return [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()]


def test_query_equals_brute_force(spark, sf):
    c = duckdb.connect()
    docs = c.execute(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    items = c.execute(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    want = brute(docs, items)
    assert any(x[-1] for x in want)
    assert sorted(rows(QUERIES["op6_decontamination_index"](spark, sf))) == sorted(want)


ITEMS = [(1, "One two THREE four five six seven eight nine ten eleven"), (2, "só cortó"), (3, None), (4, "... !"), (5, "a a a a a a a a a a a")]
DOCS = [
    (1, "x one two three four five six seven eight nine ten; y"), (2, None), (3, ""), (4, "SÓ cortó"), (5, "so, Só--cortó\tsó cortó"), (6, "a " * 30), (6, "a " * 30),
    (7, "two one three four five six seven eight nine ten"), (None, "two three four five six seven eight nine ten eleven"), (8, "one two three four five"), (9, "word " * 50_000 + "só cortó"),
]


def frames(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("doc_id", "text", "text as positions", "1 as block")
    return d, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_edges(spark, monkeypatch):
    d, b = frames(spark)
    want = {(x[0], x[2], x[3]) for x in brute(DOCS, ITEMS)}
    got = decontam.matches(d, b).collect()
    assert len(got) == len(DOCS)
    assert {(r.doc_id, len(r.hit_at), len(r.items)) for r in got} == want
    assert {r.doc_id for r in got if "1" in r.near_items} == {1, 7, None}
    assert decontam.matches(d.limit(0), b).count() == 0
    assert all(not r["items"] for r in decontam.matches(d, b.limit(0)).collect())
    kept = decontam.decontaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7, 8]


def test_rows_are_judged_and_not_ids(spark):
    hit, clean = "x " + ITEMS[0][1], "nothing of that kind"
    rows = [(7, hit), (7, clean), (None, hit), (None, clean), (None, None), (8, clean)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in decontam.decontaminated(d, frames(spark)[1]).collect()}
    assert kept == {(7, clean), (None, clean), (None, None), (8, clean)}


def test_one_index_serves_several_test_sets(spark, monkeypatch):
    d, b = frames(spark)
    told = lambda df: sorted((str(r.doc_id), r.hit_at, r["items"], r.near_items) for r in df.collect())
    whole = decontam.positional_index(d)
    for tests in (b, b.where("item_id = 2")):
        assert told(decontam.matches(d, tests, index=whole)) == told(decontam.matches(d, tests))
    want = told(decontam.matches(d, b))
    monkeypatch.setattr(decontam, "MOST_TERMS", 3)
    assert told(decontam.matches(d, b)) == want


def test_parts_and_blocks_agree(spark, monkeypatch):
    d, b = frames(spark)
    want = sorted((str(r.doc_id), r.hit_at, r["items"], r.near_items) for r in decontam.matches(d, b).collect())
    monkeypatch.setattr(decontam, "PART_BYTES", 20)
    assert sorted((str(r.doc_id), r.hit_at, r["items"], r.near_items) for r in decontam.matches(d, b).collect()) == want
