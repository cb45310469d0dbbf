import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftlight.llm import mixing as M

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base(rows):
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(t for d, x in rows if not fold(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return {d: (fold(d), len(tokens(x)), sum(t in c for t in tokens(x)), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x))) for d, x in rows}


@pytest.mark.parametrize("hot", [1 << 18, 40])
def test_counts_and_base_score(spark, hot):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [*map(tuple, docs.collect()), (5000, None), (5001, ""), (5002, "x" * 3000 + " É \x00 end"), (None, "no id the")]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string")
    got = {r["doc_id"]: r for r in M.score(df, hot=hot).collect()}
    want = base(rows)
    assert set(got) == set(want)
    for d, (held, n, known, total, b) in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total), d
        assert math.isclose(r["base_score"], b, rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    trained = [d for d in want if not want[d][0]]
    assert sum(got[d]["score"] for d in trained) > sum(want[d][4] for d in trained)


def test_held_out_texts_score_above_the_base(spark):
    rows = M.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_empty_and_no_training_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.score(df).count() == 0
    held = next(d for d in range(1000) if zlib.crc32(str(d).encode()) % 10 == 0)
    r = M.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0


def test_prefix_code_is_one():
    rng = np.random.default_rng(0)
    code, length = M.prefix_code(rng.integers(1, 10_000, 500).astype(float))
    words = sorted(format(c, f"0{n}b") for c, n in zip(code.tolist(), length.tolist(), strict=True))
    assert all(not b.startswith(a) for a, b in zip(words, words[1:]))
    owner, depth, node, bit = M.expand(code, length)
    assert len(owner) == length.sum()
    for i in (0, 77, 499):
        assert "".join(str(int(b)) for b in bit[owner == i]) == format(code[i], f"0{length[i]}b")


def test_probabilities_of_all_symbols_sum_to_at_most_one(spark):
    model, _ = M.train(spark.read.parquet(f"{SF}/documents.parquet"))
    n = len(model.alphabet.code)
    for before in ([], [0, 3], [5, 5]):
        reader, total = M.Reader(model.alphabet), 0.0
        for lo in range(0, n, 500):
            codes = np.array([[*before, k] for k in range(lo, min(n, lo + 500))])
            ends = np.arange(1, len(codes) + 1) * codes.shape[1]
            owner, depth, bit, at = reader.bits(codes.ravel(), ends)
            s, sign = model.inputs(range(3), at), np.where(bit, 1, -1)
            w = model.word_weights[:, M.gates(depth, s, M.foretold(owner, s, sign, ends))]
            p = 1 / (1 + np.exp(-(w * s).sum(axis=0) * sign))
            last = np.isin(owner, ends - 1)
            total += np.exp(np.bincount(owner[last], np.log(p[last]))[ends - 1]).sum()
        assert 0.5 < total <= 1 + 1e-6


def test_words_of_a_column_are_those_of_each_text():
    texts = [" Two\x0bWords ", None, "", "\t", "É é\u00a0x\x1cY Z\x00", "A", "a\r\nB  c"]
    flat, size = M.split_words(pa.array(["cut off", *texts]).slice(1))
    want = [[t.encode() for t in tokens(x)[:-1]] for x in texts]
    assert flat.to_pylist() == [t for x in want for t in x] and size.tolist() == [len(x) for x in want]


def test_weights_are_fitted_to_every_bit_of_all_training_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    model, _ = M.train(docs, hot=2000)
    reader = M.Reader(model.alphabet)
    texts = [r["text"] for r in docs.collect()]
    assert len(texts) > 256
    codes, ends = reader.read(pa.array(texts))
    size, _, _, _ = reader.expanded(codes, ends)
    assert model.fitted_bits == (size.sum(), sum(int(model.alphabet.byte_length[list(w + b" ")].sum()) for w in reader.spelled))


def test_fitted_weights_are_the_likeliest():
    rng = np.random.default_rng(1)
    point = np.concatenate([-np.array(M.GRID[:0:-1]), M.GRID])
    cells = rng.choice(len(point) ** 3, 400, replace=False)
    x = point[np.stack(np.unravel_index(cells, (len(point),) * 3))]
    true = np.array([0.5, 0.2, 0.35])
    one = np.rint(1e6 / (1 + np.exp(-(true @ x))))
    w = M.fitted([(7, cells, np.stack([1e6 - one, one]))], M.WORD_START)
    assert np.allclose(w[:, 7], true, atol=1e-3) and np.allclose(w[:, 8], M.WORD_START)


def test_log_odds_on_the_grid_keep_their_place():
    level = M._levels()[np.rint(np.array([*M.GRID, *(-g for g in M.GRID)]) * M.SCALE).astype(np.int16).view(np.uint16)]
    assert level.tolist() == [*range(12, 25), *range(12, -1, -1)]


def test_texts_that_never_adapt_are_mixed_at_once(spark, monkeypatch):
    """Every text took a call of its own before; the losses are those of each text alone."""
    model, _ = M.train(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = [f"the house {i} is new and w{i}" for i in range(300)] + ["far more words than that " * 400, "", None, "the end"]
    reader = M.Reader(model.alphabet)
    alone = [M.score_blocks(model, reader, pa.array([x], pa.string()))[0][0] for x in texts]
    calls, plain = [], M.adapt
    monkeypatch.setattr(M, "adapt", lambda w, g, *a, **k: calls.append(len(g)) or plain(w, g, *a, **k))
    loss, _, _ = M.score_blocks(model, reader, pa.array(texts))
    assert np.allclose(loss, alone, rtol=1e-5)
    assert sum(n > M.STEP for n in calls) == 1 and sum(n != M.STEP for n in calls) <= 3


def test_one_look_gives_slot_stage_and_bit():
    code, length = M.prefix_code(np.random.default_rng(2).integers(1, 9000, 400).astype(float))
    _, depth, node, bit = M.expand(code, length)
    codes = M.Codes(code, length, 2, 5)
    for table in (2, 5):
        got = codes.look(table, np.arange(len(bit)))
        stage, one = M.marks(got)
        assert (stage == np.minimum(depth // 2, 3)).all() and (one == bit).all() and (M.slot_part(got, table) == M.node_hash(node, depth, table)).all()
