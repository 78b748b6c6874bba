import gzip
import random

from pyspark.sql import functions as F
import pytest

from tests.llm.oracle import same
from tilesmith.llm import warc
from tilesmith.llm.registry import ORACLE, QUERIES

PAGES = "page_id long, url string, html string"


def test_query_equals_sql(spark, sf):
    assert {r["record_type"] for r in same(spark, sf, "op12_warc_segments", QUERIES, ORACLE)} <= {"response", "revisit"}


def brute(rows, least=0):
    first = {}
    for d, _, x in rows:
        x = (x or "").encode()
        if len(x) >= least:
            first[x] = min(first.get(x, d), d, key=lambda v: (v is None, v))
    out = []
    for d, _, x in rows:
        x = (x or "").encode()
        own = x not in first or first[x] == d
        out.append((d, len(x), warc.digest_of(x), "response" if own else "revisit", None if own else first[x]))
    return sorted(out, key=str)


def rows_of():
    rng = random.Random(3)
    odd = ["\r\n\r\n", "\r\n", "\r", "\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "0\r\n\r\n", "é日本\U0001f600", "\x00\x01"]
    rows = [(None, None, None), (1, "http://a/ b\r\nWARC-Type: x", ""), (2, None, "same"), (3, "u", "same"), (3, "v", "same"), (4, "http://é/", "x" * 3_000_000), (5, "", "x" * 3_000_000), (-6, "u", "\r\n\r\n"), (7, "u", "\r\n" * 5), (None, "u", "same"), (None, "u", "only without an id"), (2**63 - 1, "u", "large id")]
    return rows + [(100 + i, f"http://h/{i}", "".join(rng.choice(odd) * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60)))) for i in range(300)]


@pytest.mark.parametrize("segment, chunk", [(warc.SEGMENT_BYTES, warc.CHUNK_BYTES), (100, 7), (1 << 30, 1 << 30)])
def test_round_trip(spark, tmp_path, segment, chunk):
    rows = [r for r in rows_of() if segment > 100 or len(r[2] or "") < 10**6]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as digest", "2 as payload", "3 as own", "4 as first_id", "5 as n").repartition(3)
    for k, least in enumerate((0, 5)):
        path = f"{tmp_path}/{k}"
        warc.write_warc(pages, path, least=least, segment_bytes=segment, chunk_bytes=chunk, date="2024-01-01T00:00:00Z")
        read = warc.read_warc(spark, path)
        assert read.where("error is not null").count() == 0
        got = warc.resolved(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, least)
        whole = sorted((r.page_id or 0, bytes(r.payload)) for r in read.where("record_type = 'response'").collect())
        asked = {(d or 0, (x or "").encode()) for d, _, x in rows}
        assert set(whole) <= asked and {x for _, x in whole} == {x for _, x in asked}
    uri = read.where("page_id = 1").first().target_uri
    assert uri == "http://a/%20b%0D%0AWARC-Type:%20x"


def test_query_edges(spark, tmp_path):
    pages = spark.createDataFrame(rows_of(), PAGES)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    pages.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert sorted(map(tuple, QUERIES["op12_warc_segments"](spark, str(tmp_path)).collect()), key=str) == brute(rows_of())
    assert QUERIES["op12_warc_segments"](spark, f"{tmp_path}/none").count() == 0


def archive(tmp_path, name, records):
    (tmp_path / name).mkdir()
    # a member for each record, as other writers do it
    (tmp_path / name / "a.warc.gz").write_bytes(b"".join(gzip.compress(x + b"\r\n\r\n") for x in records))
    return str(tmp_path / name)


def record(kind, block, **headers):
    return warc._record([("WARC-Type", kind), *((k.replace("_", "-"), v) for k, v in headers.items())], block)


def test_damaged_and_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    seg = lambda n, block, kind="continuation", total=None: record(kind, block, **({"WARC_Record_ID": "o"} if n == 1 else {"WARC_Record_ID": f"c{n}", "WARC_Segment_Origin_ID": "o"}), WARC_Segment_Number=n, WARC_Segment_Total_Length=total)
    plain = [
        record("response", http + b"plain", WARC_Record_ID="p"), record("response", http[:10], WARC_Record_ID="h"), record("request", b"GET", WARC_Record_ID="q"), b"garbage\r\n\r\nmore garbage",
        record("response", http.replace(b"X: y", b"transfer-encoding: Chunked") + b"3;x=y\r\nabc\r\n0\r\nTrailer: t\r\n\r\n", WARC_Record_ID="k"),
        record("response", http.replace(b"X: y", b"Transfer-Encoding: chunked") + b"9\r\nabc\r\n0\r\n\r\n", WARC_Record_ID="b"),
        record("response", http + b"z", WARC_Record_ID="d", WARC_Payload_Digest="sha1:AAAA"), record("revisit", http, WARC_Record_ID="r", WARC_Payload_Digest="sha1:BBBB"),
        record("response", http + b"folded", WARC_Record_ID="f").replace(b"WARC-Type: ", b"WARC-Type:\r\n  "),
    ]
    read = warc.read_warc(spark, archive(tmp_path, "plain", plain))
    got = {r.record_id: r for r in warc.resolved(read).collect()}
    sizes = {k: (r.payload_bytes, r.error is None) for k, r in got.items()}
    assert sizes == {"p": (5, True), "h": (None, False), None: (None, False), "k": (3, True), "b": (None, False), "d": (1, False), "r": (None, False), "f": (6, True)}
    for name, parts, error in (
        ("good", [seg(2, b"lo "), seg(1, http + b"hel", "response"), seg(3, b"you", total=len(http) + 9)], None),
        ("short", [seg(1, http + b"hel", "response"), seg(2, b"lo", total=4)], "total length"),
        ("gap", [seg(1, http, "response"), seg(3, b"lo", total=len(http) + 2)], "missing or repeated"),
        ("open", [seg(1, http, "response"), seg(2, b"lo")], "missing or repeated"),
        ("headless", [seg(2, b"lo", total=2)], "origin"),
        ("cut", [record("response", http + b"whole", WARC_Record_ID="w")[:-3]], "cut off"),
        ("cut_more", [record("response", http + b"whole", WARC_Record_ID="w")[:-20]], "cut off"),
        ("long", [record("response", http + b"whole", WARC_Record_ID="w") + b"more", record("request", b"GET" * 99)], "longer or shorter"),
    ):
        rows = warc.read_warc(spark, archive(tmp_path, name, parts)).collect()
        assert len(rows) == 1 and (error is None) == (rows[0].error is None) and (error or "") in (rows[0].error or ""), name
        if name == "good":
            assert bytes(rows[0].payload) == b"hello you" and rows[0].record_type == "response"


def test_a_payload_of_many_segments_is_whole(spark, tmp_path):
    text = "".join(f"{i},\r\n\r\n" for i in range(200_000))
    pages = spark.createDataFrame([(1, "u", text)], PAGES)
    warc.write_warc(pages, f"{tmp_path}/w", segment_bytes=1000)
    row = warc.read_warc(spark, f"{tmp_path}/w").first()
    assert bytes(row.payload) == text.encode() and row.error is None
    assert spark.read.text(f"{tmp_path}/w", lineSep="\r\n\r\n").where(F.col("value").contains("WARC-Segment-Number")).count() > 1000
