import hashlib

import duckdb
import pytest

from weftlight.llm.bpe import bpe_round_trip, codec
from weftlight.llm.common import tokenizer_path
from weftlight.llm.pretokens import BytePretokens, library

ODD = ["", " ", "a", "  a  b ", "Hello, it's 123 tests!", "ΟΔΥΣΣΕΥΣ ΣΑΣ İstanbul", "x" * 5000, "é ë á", "a<|endoftext|>b <|startoftext|>", "tab\tnew\n\nline \n  x", "a\x1cb\x85c d e", "日本語 テスト 你好", "😀😀 'll 've don't", "ꟋᲉ x1y2", "퟿�", "a\n b", "a \nb", "q\n", "\nq", "0" * 300]


@pytest.fixture(scope="module")
def texts():
    return ODD + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]


def test_word_ids_and_decoding_equal_the_library(texts):
    path = tokenizer_path("word_bpe_49k.json")
    lib, own = library(path), codec(path)
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, t[:50]
        assert own.decode_decimal(own.encode_decimal(t)) == lib.decode(want, skip_special_tokens=False)


def test_byte_chunks_equal_the_library(texts):
    path = tokenizer_path("byte_bpe_50k.json")
    cut, lib = BytePretokens(path), library(path).pre_tokenizer
    for t in texts:
        want = [t[a:b] for _, (a, b) in lib.pre_tokenize_str(t)]
        chunks = cut.chunks(t)
        assert "".join(chunks) == t
        assert [x for c in chunks for x in cut.pretokens(c)] == want, t[:50]


def test_rows_nulls_and_extra_columns(spark):
    path = tokenizer_path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "Hello", 5), (1, "Hello", 5), (2, None, 1), (None, "", 2)], "doc_id long, text string, n_tokens int")
    rows = sorted(bpe_round_trip(df, path).collect(), key=str)
    assert sorted(r["n_tokens"] for r in rows) == [0, 0, 1, 1]
    d = bpe_round_trip(df.filter("doc_id = 2"), path, digests=True).collect()[0]
    assert d["ids_sha256"] == hashlib.sha256(b"").hexdigest() == d["decoded_sha256"]
    assert bpe_round_trip(df.limit(0), path).count() == 0
