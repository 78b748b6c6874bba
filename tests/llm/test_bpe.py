import hashlib

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tilesmith.llm import bpe
from tilesmith.llm.registry import BPE_RANKS, QUERIES

PATH = P.path(BPE_RANKS)
RANKS = bpe.read_ranks(PATH)
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_query_equals_the_library(spark, sf):
    want = []
    for i, t in duckdb.connect().execute(f"select doc_id, text from '{sf}/documents.parquet'").fetchall():
        ids = ENC.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op3_byte_bpe"](spark, sf).collect())) == sorted(want)


TEXTS = [None, "", " ", "  \n\n x", "it's\x1c\x85  we'll <|endoftext|>", "日本語のテキスト 👩‍👩‍👧 é é", "a" * 40_000, "ab " * 30_000, "0123456789" * 30, "\0 a\0b", "same", "same"]


def test_edges(spark, monkeypatch):
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").selectExpr("*", "'b' as block", "1 as word", "array(1) as ids")
    for size in (bpe.BLOCK_CHARS, 10):
        monkeypatch.setattr(bpe, "BLOCK_CHARS", size)
        got = {r.doc_id or 0: (r.ids, bytes(r.bytes)) for r in bpe.decoded(bpe.encoded(df, PATH, P.PATTERN), PATH).collect()}
        assert got == {i: (ENC.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(TEXTS)}
    assert bpe.encoded(df.limit(0), PATH, P.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(min_size=1, max_size=200), st.text(alphabet="aeinrst ", min_size=1, max_size=150).map(str.encode)))
def test_both_ways_of_merging_agree(word):
    scanned = bpe.merged(word, RANKS) if len(word) <= bpe.SCAN_BYTES else None
    heaped = bpe._heap_merged(word, RANKS)
    assert b"".join(ENC.decode_single_token_bytes(i) for i in heaped) == word
    if word not in RANKS and scanned is not None:
        assert scanned == heaped


def test_unknown_ids_stop_the_job(spark):
    with pytest.raises(Exception, match="IndexError"):
        bpe.decoded(spark.sql("select 1L as doc_id, array(999999) as ids"), PATH).collect()


@pytest.mark.parametrize("ids", ["array(-1)", "array(2)", "array(0, 1)"])
def test_ids_outside_the_ranks_stop_the_job_and_gaps_shift_nothing(spark, tmp_path, ids):
    path = tmp_path / "gap.tiktoken"
    path.write_text("YQ== 1\nYg== 3\n")  # a and b, no rank 0 and 2
    with pytest.raises(Exception, match="IndexError"):
        bpe.decoded(spark.sql(f"select 1L as doc_id, {ids} as ids"), str(path)).collect()
    assert bytes(bpe.decoded(spark.sql("select 1L as doc_id, array(3, 1, 3) as ids"), str(path)).first().bytes) == b"bab"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=st.characters(max_codepoint=255), max_size=60), st.text(alphabet="a1é' \n\t\x1c\x85\xa0²'st", max_size=40)))
def test_both_engines_find_the_same(text):
    assert bpe.finder(P.PATTERN)(text) == bpe.regex.findall(P.PATTERN, text)


def test_patterns_that_only_one_engine_knows():
    assert bpe._latin(P.PATTERN)
    assert bpe._latin(r"\w+|\p{Lu}") is None
    assert bpe.finder(r"\p{Lu}\p{Ll}+")("Ab éÉé") == ["Ab", "Éé"]
