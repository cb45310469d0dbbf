import zlib

import numpy as np
from pyspark.sql import functions as F

from weftlight.llm.quality import FEATURES, POOLED, ROUND, quality_scores, statistics

SF = "/root/testdata/sf0.01"


def plain(docs, labels):
    """Class covariances by numpy.cov, densities by solve and slogdet, one text at a time."""
    x = np.array([statistics((t or "").encode()) for _, t in docs])
    y = np.array([labels.get(i, -1) if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 else -1 for i, _ in docs])
    mu, sd = x[y >= 0].mean(axis=0), x[y >= 0].std(axis=0)
    z = (x - mu) / np.where(sd > 1e-6, sd, 1)
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    share = np.array([(y == c).sum() for c in (0, 1)]) / (y >= 0).sum()
    both = share[0] * own[0] + share[1] * own[1]
    out = []
    for v in z:
        logs = []
        for c in (0, 1):
            s = (1 - POOLED) * own[c] + POOLED * both
            s = (1 - ROUND) * s + (ROUND * np.trace(s) / len(v) + 1e-6) * np.eye(len(v))
            gap = v - z[y == c].mean(axis=0)
            logs.append(np.log(share[c]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * gap @ np.linalg.solve(s, gap))
        out.append(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))
    return out


def test_scores_equal_the_plain_densities_and_held_out_rows_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None), (None, "a b"), (-1, ""), (-2, "x" * 200_000), (-2, "x" * 200_000), (-3, "\n \t\r")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd).withColumn("quality", F.lit(1)).withColumn("id", F.lit("c"))
    got = [tuple(r) for r in quality_scores(every, labels.withColumn("text", F.lit(0))).collect()]
    rows = [tuple(r) for r in every.select("doc_id", "text").collect()]
    mark = {r["doc_id"]: r["quality"] for r in labels.collect()}
    key = lambda r: (r[0] is not None, r[0] or 0, r[-1])
    want = sorted(((i, round(s, 6)) for (i, _), s in zip(rows, plain(rows, mark), strict=True)), key=key)
    assert sorted(((i, round(s, 6)) for i, _, s, _ in got), key=key) == want
    assert all(p == (s >= 0.7) and 0 <= s <= 1 for _, _, s, p in got)
    assert all(h == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2) for i, h, _, _ in got)
    held = [(mark[i], s, p) for i, h, s, p in got if h and i in mark]
    assert np.mean([p == y for y, _, p in held]) > 0.95
    good, bad = ([s for y, s, _ in held if y == c] for c in (1, 0))
    assert np.mean([[a > b for a in good] for b in bad]) > 0.99


def test_without_labels_of_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b c"), (3, None)], "doc_id long, text string")
    kind = "doc_id long, quality int"
    assert {r["score"] for r in quality_scores(docs, spark.createDataFrame([], kind)).collect()} == {0.5}
    assert {(r["score"], r["predicted"]) for r in quality_scores(docs, spark.createDataFrame([(1, 1), (1, 0), (3, None), (9, 0)], kind)).collect()} == {(2 / 3, 0)}
    assert quality_scores(docs.limit(0), spark.createDataFrame([(1, 1)], kind)).count() == 0


def test_a_label_of_every_class_is_enough(spark):
    docs = spark.createDataFrame([(1, "some text here"), (3, "#### $$$$"), (4, "other text here"), (5, "some text here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality_scores(docs, labels, held_out=(1, 5)).collect()}
    assert got[1] == got[5] > 0.7 > got[3]


def test_statistics_are_finite_for_any_text():
    for data in (b"", b" ", b"\n\n", b"\xff\xfe", b"a" * 100_000, "é日本".encode() * 50, bytes(range(256))):
        assert len(statistics(data)) == len(FEATURES) and np.isfinite(statistics(data)).all()
