import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from tilesmith.llm import lmscore
from tilesmith.llm.registry import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tok(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(rows):
    """rows: (doc_id, target, lang, text) -> doc_id, n, losses by the counts of all other rows."""
    size = defaultdict(lambda: [0, 0])
    for _, t, lang, text in rows:
        size[lang or ""][not t] += len((text or "").encode())
    all_t, all_b = (sum(x[c] for x in size.values()) for c in (0, 1))
    weight = {k: math.floor((t / all_t * all_b / b if b and all_t else 1) * 1024 + 0.5) / 1024 for k, (t, b) in size.items()}
    one, two, whole = Counter(), Counter(), Counter()
    for _, t, lang, text in rows:
        ws, n = tok(text), 1 if t else weight[lang or ""]
        for a, b in zip(["<s>", *ws], ws):
            one[b, not t] += n
            two[a, b, not t] += n
        if ws:
            one["<s>", not t] += n
        whole[not t] += n * len(ws)
    vocabulary = {w for w, _ in one}
    out = []
    for i, t, lang, text in rows:
        ws = tok(text)
        single, double = Counter(["<s>", *ws]), Counter(zip(["<s>", *ws], ws))
        loss = [0.0, 0.0]
        for c in (0, 1):
            f = (1 if t else weight[lang or ""]) if c == (not t) else 0
            for a, b in zip(["<s>", *ws], ws):
                p = (one[b, c] - f * single[b] + 1) / (whole[c] - f * len(ws) + len(vocabulary))
                if (first := one[a, c] - f * single[a]) > 0:
                    p = 0.3 * p + 0.7 * (two[a, b, c] - f * double[a, b]) / first
                loss[c] -= math.log(p) / len(ws)
        out.append((i, len(ws), *loss))
    return sorted(out, key=str)


def close(got, want):
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for g, w in zip(got, want):
        assert g[2:] == pytest.approx(w[2:], rel=1e-9)


def test_query_equals_brute_force(spark, sf):
    c = duckdb.connect()
    rows = c.execute(f"select d.doc_id, coalesce(l.quality = 1 and l.toxic = 0, false), lang, text from '{sf}/documents.parquet' d left join '{sf}/labels.parquet' l using (doc_id)").fetchall()
    got = QUERIES["op2_lm_cross_entropy"](spark, sf).collect()
    close(sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got), key=str), brute(rows))
    assert all(r.score == pytest.approx(r.background_loss - r.target_loss) for r in got)


def test_a_target_like_text_scores_higher(spark):
    rows = [(i, i < 20, "en", ("alpha beta gamma delta " if i < 20 else "one two three four ") * 5) for i in range(40)] + [(90, None, "en", "alpha beta gamma"), (91, False, "en", "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, target boolean, lang string, text string")
    got = {r.doc_id: r.score for r in lmscore.scored(df, F.col("target")).collect()}
    assert got[90] > 0.5 > 0 > got[91]


def test_edges(spark):
    rows = [(None, True, "en", None), (1, None, None, ""), (2, False, "de", "... !"), (3, True, "en", "word " * 80_000 + "other"), (4, False, "en", "word other"), (4, False, "en", "word other"), (5, True, "fr", "seul mot seul mot"), (6, False, "de", "Ünder ünder")]
    df = spark.createDataFrame(rows, "doc_id long, target boolean, lang string, text string").selectExpr("*", "1 as t", "2 as b", "3 as word", "4 as score", "5 as n_tokens")
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in lmscore.scored(df, F.col("target")).collect()), key=str)
    close(got, brute([(i, bool(t), lang, x) for i, t, lang, x in rows]))
    assert lmscore.scored(df.limit(0), F.col("target")).count() == 0
    assert lmscore.scored(df, F.lit(False)).count() == len(rows)


def test_blocks_ranges_and_slices_agree(spark, sf, monkeypatch):
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("target", F.col("doc_id") % 3 == 0)
    told = lambda: sorted((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in lmscore.scored(d, F.col("target")).collect())
    want = told()
    for name, value in (("BLOCK_CHARS", 20_000), ("RANGE_TOKENS", 2000), ("SLICE_TOKENS", 100)):
        monkeypatch.setattr(lmscore, name, value)
    close(told(), want)


def test_copies_are_told_from_single_texts(spark):
    text = lambda i: " ".join(f"w{(i * 31 + j * j * 7) % 997}" for j in range(80))
    rows = [(i, i % 2 == 0, "en", text(i)) for i in range(100)] + [(100 + i, False, "en", text(1 + 2 * i)) for i in range(5)]
    got = {r.doc_id: r.background_loss for r in lmscore.scored(spark.createDataFrame(rows, "doc_id long, target boolean, lang string, text string"), F.col("target")).collect()}
    twice = {1 + 2 * i for i in range(5)} | {100 + i for i in range(5)}
    assert max(got[i] for i in twice) < min(got[i] for i in set(got) - twice)
