import math

import numpy as np
import pytest

from weftlight.llm.topk import top_k


def brute(rows, k, every):
    v = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v[i] = [math.floor(1024.0 * float(np.float32(x))) for x in e]
    out = []
    for q in v:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 3])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(1000, 1040)]  # ties
    rows += [(2000, None), (2010, [None] * 8), (2020, [float("nan")] * 8), (2030, [float("inf")] * 8), (None, rows[0][1]), (2040, [0.5]), (2050, [0.25]), (2060, [3e4] * 8), (2070, [-3e4] * 8)]
    df = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<float>, score int, rank int").repartition(5)
    got = sorted(map(tuple, top_k(df, 10, 10, query_block=block).collect()))
    assert got == brute(rows, 10, 10)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df).collect()] == [(0, 1, 1, 524288)]
    assert top_k(df.limit(0)).count() == 0
