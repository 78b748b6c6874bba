import hashlib
import re
from collections import Counter

import duckdb
import pytest
from tilesmith.llm import imatch
from tilesmith.llm.registry import QUERIES


def brute_terms(t):
    import regex

    return set(filter(None, regex.split(r"[^\p{L}\p{N}]+", (t or "").lower())))


def brute(spark, docs, band=imatch.BAND):
    """docs: (doc_id, text), ascending. Hashes of a subset are stood in for by its sorted terms."""
    n = len(docs)
    df = Counter(x for _, t in docs for x in brute_terms(t))
    lex = [x for x, c in df.items() if max(2, band[0] * n) <= c <= band[1] * n]
    keys = [(r, f) for r in range(1, imatch.LEVELS + 1) for f in range(imatch.FAMILIES)]
    rows = spark.createDataFrame([(x,) for x in lex], "term string").selectExpr("term", *(f"xxhash64({f}, term) & {(1 << r) - 1}L = 0 as k{k}" for k, (r, f) in enumerate(keys))).collect()
    member = {r.term: [k for k in range(imatch.SUBSETS - 1) if r[f"k{k}"]] for r in rows}

    def fp(t):
        own = brute_terms(t)
        hit = sorted(x for x in own if x in member)
        if not hit:
            return [("no lexicon term", *sorted(own))] + [None] * (imatch.SUBSETS - 1)
        return [tuple(hit)] + [tuple(x for x in hit if k in member[x]) or None for k in range(imatch.SUBSETS - 1)]

    def like(a, b):
        pairs = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
        return sum(x == y for x, y in pairs) / len(pairs)

    out = []
    for i, (d, t) in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % n][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), like(fp(t), fp(e)), like(fp(t), fp(nxt))))
    return out


def same(got, want):
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == [w[:3] for w in want]
    for r, w in zip(got, want):
        assert (r.near_edited, r.near_next) == pytest.approx(w[3:])


def test_query_equals_brute_force(spark, sf, monkeypatch):
    docs = duckdb.connect().execute(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()
    want = brute(spark, docs)
    for size in (imatch.RUN_DOCS, 7):
        monkeypatch.setattr(imatch, "RUN_DOCS", size)
        got = sorted(QUERIES["op7_imatch"](spark, sf).collect())
        same(got, want)
    by_text = {}
    for r, (_, t) in zip(got, docs):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert all(re.fullmatch(r"([0-9a-f]{8}|\.{8})+", r.fingerprint) for r in got)
    assert sum(r.near_edited for r in got) > 3 * sum(r.near_next for r in got)


ROWS = [(1, None), (2, ""), (3, "É 日本 a"), (4, "w " * 100_000 + "end"), (5, "same words here"), (6, "same words here"), (9, "?!"), (12, "other words there and here")]


def test_edges(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as run", "2 as term", "3 as mask", "4 as hash", "5 as pos", "6 as ghost")
    for size in (2000, 1, 3):
        monkeypatch.setattr(imatch, "RUN_DOCS", size)
        same(sorted(imatch.fingerprints(df, band=(0.1, 0.9)).collect()), brute(spark, ROWS, (0.1, 0.9)))
    assert imatch.fingerprints(df.limit(0)).count() == 0
    one = imatch.fingerprints(df.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    tied = df.where("doc_id > 4").selectExpr("cast(null as long) as doc_id", "text").union(df.where("doc_id in (5, 6)").selectExpr("5L", "text"))
    assert imatch.fingerprints(tied).count() == 6


def test_runs_are_of_one_size(spark, monkeypatch):
    """Also where a third of all rows has no id, and others share one; rows that share id and text stay together."""
    monkeypatch.setattr(imatch, "RUN_DOCS", 50)
    df = spark.range(6000).selectExpr("case when id < 2000 then null when id < 3500 then 7 else id * 11 end as doc_id", "concat('text ', id) as text")
    rows = imatch.neighbours(df).where("not ghost").select("run", "doc_id", "text", "next").collect()
    sizes = Counter(r.run for r in rows)
    assert len(rows) == 6000 and max(sizes.values()) <= 50 and len(sizes) <= 6000 / 50 + 12
    follows = {r.text: r.next for r in rows}
    seen, at = set(), rows[0].text
    while at not in seen:  # one circle through all rows
        seen.add(at)
        at = follows[at]
    assert len(seen) == 6000
    same_rows = df.union(spark.range(300).selectExpr("7L as doc_id", "'twin' as text"))
    assert imatch.neighbours(same_rows).where("not ghost").count() == 6300
