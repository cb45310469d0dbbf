"""Exact dense search by blocks of a matrix product, with local top-k before anything moves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Questions that are broadcast at once.
QUESTION_BLOCK = 2048


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1, norm)


def cosine_top_k(vectors: DataFrame, questions: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", question_col: str = "query_id", digits: int = 6) -> DataFrame:
    """(question, id, score, rank): the k highest cosines of each question over all vectors, positive ones only.

    Questions go out in blocks of QUESTION_BLOCK, so what is broadcast is bounded. Every task multiplies a batch of
    vectors with the block and keeps k per question and task; only those are shuffled. A question's own id is skipped.
    """
    spark = vectors.sparkSession
    q = questions.select(F.col(question_col).alias("q"), F.col(vec_col).alias("v")).filter("v is not null")
    n_blocks = max(1, -(-q.count() // QUESTION_BLOCK))
    out = None
    for block in range(n_blocks):
        part = q.filter(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == block).toArrow()
        ids, m = part.column("q").to_numpy(), _unit(_matrix(part.column("v")))
        shared = spark.sparkContext.broadcast((ids, m))

        def run(batches, shared=shared):
            qs, qm = shared.value
            a, c, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for b in batches:
                if not b.num_rows or not len(qs):
                    continue
                cid = b.column(0).to_numpy(zero_copy_only=False)
                best = [(a, c, s)]
                dots = np.round(qm @ _unit(_matrix(b.column(1))).T, digits)
                dots[qs[:, None] == cid[None]] = -np.inf
                for j in range(len(qs)):
                    top = np.lexsort((cid, -dots[j]))[:k]
                    top = top[dots[j][top] > 0]
                    best.append((np.full(len(top), qs[j]), cid[top], dots[j][top]))
                # what a task holds is k a question, however many batches it reads
                a, c, s = (np.concatenate(x) for x in zip(*best, strict=True))
                order = np.lexsort((c, -s, a))
                a, c, s = a[order], c[order], s[order]
                keep = np.arange(len(a)) - np.searchsorted(a, a) < k
                a, c, s = a[keep], c[keep], s[keep]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(s)], names=[question_col, id_col, "score"])

        rows = vectors.filter(F.col(vec_col).isNotNull()).select(id_col, vec_col).mapInArrow(run, f"{question_col} long, {id_col} long, score double")
        out = rows if out is None else out.unionByName(rows)
    w = Window.partitionBy(question_col).orderBy(F.col("score").desc(), id_col)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cosine(a, b):
    """Cosine of two array columns in the JVM, for pairs that are already joined."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def normalised(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """The vectors at unit length, in doubles."""
    v = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn(vec_col, F.transform(v, lambda x: x / norm))
