import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
from tilesmith.llm import runs
from tilesmith.llm.registry import QUERIES


def brute_runs(w, least=12):
    """All (start, length, period): a stretch for each period by comparing words, without those of a smaller period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return [(s, n, q) for (s, n), q in sorted(found.items())]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_echo(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def brute(doc_id, w, least=12):
    rows = brute_runs(w, least)
    best = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in rows for i in range(s + q, s + n)}
    told = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    milli = 1000 * best[1] // best[2] if rows else None
    return (doc_id, len(rows), best[0], best[1], best[2], milli, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force(spark, sf, monkeypatch):
    docs = duckdb.connect().execute(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    docs = [d for d in docs if len(words(d[1])) < 3000]
    want = sorted(brute(d, brute_echo(d, words(t))) for d, t in docs)
    assert sum(r[1] > 0 for r in want) > 10
    for size in (runs.BLOCK_WORDS, 500):
        monkeypatch.setattr(runs, "BLOCK_WORDS", size)
        got = {r.doc_id: tuple(r) for r in QUERIES["op11_suffix_tree_runs"](spark, sf).collect()}
        assert [got[d] for d, *_ in want] == want


def numbers(w):
    own = {}
    return np.array([own.setdefault(x, len(own)) for x in [*w, None]])


def test_runs_of_small_alphabets():
    rng = random.Random(7)
    for k in range(1500):
        n = rng.randrange(0, 70)
        w = [rng.choice("ab" if k % 3 else "abcde") for _ in range(n)]
        if n and k % 2:
            p = rng.randrange(1, n + 1)
            w = [w[i % p] for i in range(n)]
            if k % 4 == 1:
                w[rng.randrange(n)] = "z"
        for least in (2, 5, 12, 16):
            want = [(s, s + m, q) for s, m, q in brute_runs(w, least)]
            assert runs.runs_of(numbers(w), least).tolist() == [list(x) for x in want], (w, least)


def test_long_periodic_texts_take_near_linear_time():
    rng = random.Random(1)
    block = [rng.randrange(1000) for _ in range(7001)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 30_000:
        fib.append(fib[-1] + fib[-2])
    for w, n in (("x" * 200_000, 1), (block * 20, 1), (fib[-1], None)):
        found = runs.runs_of(numbers(w))
        assert len(found) == n if n else len(found) > 5000
    assert runs.runs_of(numbers(block * 20)).tolist()[0] == [0, 140_020, 7001]


def test_edges(spark):
    row = "one two three four five six seven "
    rows = [(None, row * 3), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "w " * 50_000), (5, row * 2), (5, row * 2), (5, row), (6, "é 日本 " * 12), (7, "x " * 11), (8, "a b c d e f " * 2 + row + "g " * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_runs", "2 as longest", "3 as _words", "4 as _g", "5 as start", "6 as period")
    cols = ("n_runs", "longest", "runs_sha256", "collapsed_sha256")
    got = sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in runs.periodic_runs(df).collect()), key=str)
    want = []
    for d, t in rows:
        b = brute(d, words(t)) if d != 4 else (4, 1, 0, 50_000, 1, None, hashlib.sha256(b"0,50000,1\n").hexdigest(), hashlib.sha256(b"w").hexdigest())
        want.append((d, b[1], None if b[2] is None else (b[2], b[3], b[4]), *b[6:]))
    assert got == sorted(want, key=str)
    assert {r.collapsed for r in runs.periodic_runs(df, texts=True).where("doc_id = 8").collect()} == {"a b c d e f " + row + "g"}
    assert runs.periodic_runs(df.limit(0)).count() == 0
    made = runs.echoed(df)
    assert made.columns == df.columns
    assert sorted(((r.doc_id, words(r.text)) for r in made.collect()), key=str) == sorted(((d, brute_echo(d, words(t))) for d, t in rows), key=str)
