import hashlib
import re
import time
from collections import defaultdict

import duckdb
import pytest
from tilesmith.llm import secrets
from tilesmith.llm.registry import QUERIES

KEY = "".join(f"[{c}{c.upper()}]" for c in "password"), "".join(f"[{c}{c.upper()}]" for c in "passwd"), "".join(f"[{c}{c.upper()}]" for c in "secret"), "".join(f"[{c}{c.upper()}]" for c in "token"), "[aA][pP][iI]_?[kK][eE][yY]"
PLAIN = {"assign": re.compile("(" + "|".join(KEY) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def brute(text):
    text, out = text or "", []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in p.finditer(text):
            if kind == "assign" and len(m[2]) >= 6 or kind == "access" and len(m[0]) >= 20 or kind == "hex" and len(m[0]) >= 24:
                out.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{a}:{e}" for a, _, k, e in sorted(out)]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = dict(duckdb.connect().execute(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    got = QUERIES["op4_secret_ownership"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in want) for k in PLAIN]
        assert set(want) <= set(filter(None, r.spans.split(",")))


KEYED = "ghp_" + "aB3dE5gH7jK9mN1pQ3rS5tU7vW9xY1zA3bC5"
ROWS = [
    (1, None, "a"), (2, "", None), (3, "Token: token: abcdefgh PASSWORD='hunter22'", "a"), (4, "é AKIA" + "A1" * 8 + " " + "0f" * 12, "b"), (5, "ſecret=abcdefgh toKen=abcdefgh api_key=\"x\"", "b"),
    *((10 + i, f"export {KEYED}", f"own{i}") for i in range(2)), *((20 + i, "https://me:pa55word@host/ x", f"own{i}") for i in range(5)), (30, "https://me:0nlyh3re@host/ x", "c"), (30, "https://me:0nlyh3re@host/ x", "c"), (31, "x" * 100_000 + " secret = abcdef", "c"),
]


def test_edges(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 as rid", "2 as value", "3 as owner", "4 as spans")
    got = {}
    rows = secrets.scanned(df).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        got.setdefault(r.doc_id, []).append([(x.kind, x.start, x.end, x.verdict) for x in r.spans])
    text = {i: t for i, t, _ in ROWS}
    for i, spans in got.items():
        base = [f"{k}:{a}:{e}" for k, a, e, _ in spans[0] if k in PLAIN]
        assert base == brute(text[i])
    assert got[10] == [[("vendor", 7, 7 + len(KEYED), "live")]]
    assert got[20] == [[]]  # five owners: copied, so the method doesn't add it
    assert got[30] == [[("url_password", 11, 19, "live")]] * 2
    assert secrets.scanned(df.limit(0)).count() == 0
    many = secrets.scanned(df.unionByName(df.where("doc_id = 3").crossJoin(spark.range(5)).selectExpr("doc_id + 100 + id as doc_id", "text", "concat('o', id) as source", "rid", "value", "owner", "spans")))
    assert {x.verdict for r in many.where("doc_id = 3").collect() for x in r.spans} == {"copied"}


def test_owners_and_repositories_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = duckdb.connect().execute(f"select doc_id, source, text from '{sf}/documents.parquet'").fetchall()
    held = defaultdict(lambda: (set(), set()))
    value = lambda kind, text: PLAIN["assign"].match(text)[2] if kind == "assign" else text
    for i, owner, text in docs:
        for x in brute(text):
            kind, a, b = x.split(":")
            for side, own in zip(held[value(kind, text[int(a) : int(b)])], (i, owner)):
                side.add(own)
    seen = set()
    text_of = {i: t for i, _, t in docs}
    for r in secrets.scanned(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        for x in r.spans:
            if x.base:
                repos, owners = held[value(x.kind, text_of[r.doc_id][x.start : x.end])]
                assert x.n_repos >= len(repos) and x.n_owners >= len(owners)  # an added candidate may hold the value too
                assert (x.verdict == "copied") == (x.n_owners > secrets.MOST_OWNERS or x.n_owners > 1 and x.n_repos > secrets.MOST_REPOS)
                seen.add((x.n_repos, x.n_owners) == (len(repos), len(owners)))
    assert True in seen


def test_both_counts_decide(spark):
    rows = [(i, "token = onlyone1", "a") for i in range(30)] + [(100 + i, "token = twohold2", "ab"[i % 2]) for i in range(30)] + [(200 + i, "token = fewrepo3", "ab"[i % 2]) for i in range(4)]
    got = {r.doc_id: (r.spans[0].n_repos, r.spans[0].n_owners, r.spans[0].verdict) for r in secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (got[0], got[100], got[200]) == ((30, 1, "live"), (30, 2, "copied"), (4, 2, "live"))


@pytest.mark.parametrize("text", ["a" * 10**6 + "://", "a.b" * 300_000, "eyJ" * 300_000, "://" * 300_000, "token " * 200_000, "-----BEGIN PRIVATE KEY-----" * 30_000, "0f" * 500_000])
def test_long_words_take_no_square_time(text):
    start = time.time()
    secrets.added_spans(text, secrets.base_spans(text))
    assert time.time() - start < 10
