"""Token counts, packing and records against the tokenizers library on whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from weftlight.llm import queries
from weftlight.llm.common import new_path, tokenizer_path
from weftlight.llm.packing import ByteIds, best_fit, pack
from weftlight.llm.pretokens import library
from weftlight.llm.records import read_index, read_records, shuffled_records, token_records, unframe, write_token_records
from weftlight.llm.tokencount import token_counts

SF = "/root/testdata/sf0.001"
ODD = [(1, ""), (2, None), (3, "a <|endoftext|> b\n\n c"), (4, "word " * 4000), (4, "word " * 4000), (None, "no id"), (7, "x" * 3000), (8, "é ß \t q\n")]


PARTS = ["a", "word", "Total:", "5", "é", "🙂", "'", "it's", ">", " ", "  ", "   ", "\t", "\r", "\n", "\n\n", "\v", "\f", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", "\u3000", "\u200b", "<|endoftext|>", "½", "中文", "A1"]


def test_white_space_of_every_kind_is_cut_as_by_the_library():
    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(1)
    ids, lib = ByteIds(path), library(path)
    for _ in range(20_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(a, b, "n", 1) for a, b in ODD], "doc_id long, text string, pretoken string, piece int")
    more = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "lang as pretoken", "1 as piece")
    return odd.unionByName(more).cache()


def truth(docs, name):
    lib = library(tokenizer_path(name))
    return [(r["doc_id"], r["text"] or "", lib.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()]


@pytest.mark.parametrize("hot", [1 << 18, 50])
def test_counts_equal_the_library(spark, docs, hot):
    got = sorted(map(tuple, token_counts(docs, tokenizer_path("byte_bpe_50k.json"), hot=hot).collect()), key=str)
    want = sorted(((d, len(t.encode()), len(i), len(i) > 1024) for d, t, i in truth(docs, "byte_bpe_50k.json")), key=str)
    assert got == want


def test_packing_is_whole_and_dense(spark, docs):
    rows = pack(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    want = defaultdict(list)
    for d, _, ids in truth(docs, "byte_bpe_50k.json"):
        want[d].append(np.array([*ids, 2], "<u4"))
    total = sum(len(x) for v in want.values() for x in v)
    assert sum(r["length"] for r in rows) == total
    places = defaultdict(list)
    for r in rows:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in want[r["doc_id"]])
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-total // 1024) * 1.05 + 1
    assert pack(docs.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_best_fit_leaves_one_small_bin():
    rng = np.random.default_rng(1)
    sizes = sorted(rng.integers(1, 1024, 5000).tolist(), reverse=True)
    bins, offsets, fills = best_fit(sizes, 1024)
    assert sum(f <= 512 for f in fills) <= 1 and sum(fills) == sum(sizes) and max(fills) <= 1024


def test_records(spark, docs):
    path = tokenizer_path("word_bpe_49k.json")
    got = token_records(docs, path).collect()
    want = sorted(((d, len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for d, _, i in truth(docs, "word_bpe_49k.json")), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    got = sorted(map(tuple, got), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), r[1], r[2]) for r in want)
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    assert token_records(docs.limit(0), path).count() == 0


def test_shuffled_reads_and_checksums(spark, docs):
    out = new_path(spark, "t")
    m = write_token_records(docs, tokenizer_path("word_bpe_49k.json"), out).collect()
    uris = [r["uri"] for r in m]
    plain = sorted((str(k), i.tobytes()) for u in uris for k, i in read_records(u))
    assert plain == sorted((str(k), i.tobytes()) for k, i in shuffled_records(uris, 5))
    assert sum(len(read_index(u)) for u in uris) == docs.count()
    data = bytearray(open(uris[0].removeprefix("file:"), "rb").read())
    data[14] ^= 1
    with pytest.raises(ValueError):
        unframe(data, 0)


def test_queries_run(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_bpe", "op5_token_counts", "op7_records"):
        assert queries.QUERIES[name](spark, SF).count() == n
