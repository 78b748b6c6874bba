from tests.llm.oracle import same
from tilesmith.llm import linededup
from tilesmith.llm.registry import ORACLE, QUERIES


def test_query_equals_sql(spark):
    got = same(spark, "/root/testdata/sf0.01", "op9_site_line_dedup", QUERIES, ORACLE)
    assert sum(r["n_dropped"] for r in got) > 0


def test_edges(spark):
    rows = [(i, f"head\nown {i}\n\nhead\n tail ", "a") for i in range(6)] + [(9, None, "a"), (10, "", None), (11, "head", "b"), (12, "head\nown", None), (13, "head", "a"), (13, "head", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as line", "7 as n_lines", "1 as host", "2 as h")
    out = linededup.line_deduplicated(df, ratio=0.5, min_pages=3)
    assert set(out.columns) == {*df.columns, "n_dropped"}
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()}
    assert got == {(i, f"own {i}\n", 5, 3) for i in range(6)} | {(9, None, 0, 0), (10, "", 1, 0), (11, "head", 1, 0), (12, "head\nown", 2, 0), (13, "", 1, 1)}
    assert out.count() == len(rows)
    assert linededup.line_deduplicated(df.limit(0)).count() == 0


def test_host_of(spark):
    urls = [("https://www.Site.org:80/a?b",), ("http://u@m.x.example.com",), ("nothing",), (None,)]
    df = spark.createDataFrame(urls, "url string")
    assert [r[0] for r in df.select(linededup.host_of(df.url)).collect()] == ["site.org", "x.example.com", None, None]
