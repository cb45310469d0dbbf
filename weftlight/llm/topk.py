"""Exact top-k inner products by a three-phase uniform threshold over the partitions of the vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlight.llm.common import columns, written

#: Queries that are broadcast at once (about; they are dealt by hash) and candidates that are multiplied at once.
QUERY_BLOCK, CANDIDATES = 2048, 2048
#: Components up to this keep every product and sum of 2^12 of them exact in doubles.
EXACT = float(1 << 20)


def parse(batch, id_col: str, vec_col: str, scale: float):
    """(ids, integer-valued double matrix) for each length of vector; vectors with null or non-finite components are left out."""
    lists = batch.column(vec_col)
    if isinstance(lists, pa.FixedSizeListArray):
        lists = lists.cast(pa.list_(lists.type.value_type))
    ids = batch.column(id_col)
    ok = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
    ids, lists = ids.filter(pa.array(ok)).to_numpy(zero_copy_only=False), lists.filter(pa.array(ok))
    flat = lists.flatten()
    values = np.floor(scale * flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.empty(0, int)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        m = values[ends[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0))
        good = np.isfinite(m).all(axis=1)
        yield d, ids[at[good]], m[good]


@dataclass
class Queries:
    ids: np.ndarray
    vectors: np.ndarray  # integer-valued doubles
    cutoff: np.ndarray | None = None

    def __post_init__(self):
        self.single = self.vectors.astype(np.float32)
        self.norm = np.sqrt((self.vectors**2).sum(axis=1))
        self.large = bool(len(self.vectors) and np.abs(self.vectors).max(initial=0) > EXACT)


def bounds(q: Queries, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single-precision scores of all pairs, and for each query how far they can be from the true ones.

    For single-precision sums of d products the error is at most about d * 2^-24 * |q| * |c|; twice that and some is taken.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        s = q.single @ c.astype(np.float32).T
    norm = np.sqrt((c**2).sum(axis=1)).max(initial=0)
    return s, (c.shape[1] + 4) * 2.0**-23 * q.norm * norm


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """True integer scores of one query; beyond 64 bits they are cut to the largest or smallest long."""
    if max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        return (c @ q).astype(np.int64)
    a = [int(x) for x in q]
    lo, hi = -(1 << 63), (1 << 63) - 1
    return np.array([max(lo, min(hi, sum(int(x) * y for x, y in zip(row, a, strict=True)))) for row in c], np.int64)


def _local_lists(shared, k: int, id_col: str, vec_col: str, scale: float):
    """Phase one in one partition: for each query a lower bound of each of its k best local scores."""

    def run(batches):
        best = {d: np.full((len(q.ids), k), -np.inf) for d, q in shared.value.items()}
        for b in batches:
            for d, ids, m in parse(b, id_col, vec_col, scale):
                q = shared.value.get(d)
                if q is None:
                    continue
                for i in range(0, len(ids), CANDIDATES):
                    c, own = m[i : i + CANDIDATES], ids[i : i + CANDIDATES]
                    s, off = bounds(q, c)
                    s = s.astype(np.float64) - off[:, None]
                    s[~np.isfinite(s)] = -np.inf
                    s[q.ids[:, None] == own[None]] = -np.inf
                    both = np.concatenate([best[d], s], axis=1)
                    best[d] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        for d, q in shared.value.items():
            row, at = np.nonzero(np.isfinite(best[d]))
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), d, np.int32)), pa.array(row.astype(np.int32)), pa.array(best[d][row, at])], names=["d", "q", "low"])

    return run


def _sufficient(shared, k: int, id_col: str, vec_col: str, scale: float):
    """Phases two and three in one partition: entries that may reach the cutoff, resolved exactly, the k best of each query."""

    def run(batches):
        for b in batches:
            out_q, out_c, out_s = [], [], []
            for d, ids, m in parse(b, id_col, vec_col, scale):
                q = shared.value.get(d)
                if q is None:
                    continue
                for i in range(0, len(ids), CANDIDATES):
                    c, own = m[i : i + CANDIDATES], ids[i : i + CANDIDATES]
                    s, off = bounds(q, c)
                    may = ~(s + off[:, None] < q.cutoff[:, None]) & (q.ids[:, None] != own[None])
                    for j in np.flatnonzero(may.any(axis=1)):
                        at = np.flatnonzero(may[j])
                        score = exact(q.vectors[j], c[at])
                        keep = np.lexsort((own[at], -score.astype(object) if q.large else -score))[:k]
                        out_q.append(np.full(len(keep), q.ids[j]))
                        out_c.append(own[at][keep])
                        out_s.append(score[keep])
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_q, out_c, out_s)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with all other rows.

    Components become floor(scale * x). Queries are the rows whose id is divisible by `every`; a query's own id is no
    candidate; vectors of another length than the query's are none either. Ties go to the smaller id. Null ids or vectors
    and vectors with null or non-finite components take no part; rows that repeat an id are
    candidates each, and one query. Queries go out in blocks of about query_block, found by hash, so what is broadcast is
    bounded whatever their number.

    Phase one: every partition gathers, for each query, lower bounds of its k best scores in single precision; the k-th
    largest of all of them is a safe cutoff. Phase two: with the cutoffs every partition collects the entries that can
    reach them. Phase three: those are resolved in exact integers, ranked, and the first k kept, first per batch and then
    over all partitions. Only lists of k per partition and query move.
    """
    spark = vectors.sparkSession
    v = columns(vectors, id_col, vec_col)
    wanted = v.filter((F.col(id_col) % every == 0) & F.col(vec_col).isNotNull())
    blocks = -(-wanted.count() // query_block)
    wanted = wanted.withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(max(1, blocks))))
    found = None
    for b in range(blocks):
        parts: dict[int, list] = {}
        for batch in wanted.filter(F.col("_b") == b).drop("_b").toArrow().combine_chunks().to_batches():
            for d, ids, m in parse(batch, id_col, vec_col, scale):
                parts.setdefault(d, []).append((ids, m))
        queries = {d: Queries(*(np.concatenate(x) for x in zip(*p, strict=True))) for d, p in parts.items()}
        for d, q in queries.items():
            _, first = np.unique(q.ids, return_index=True)
            queries[d] = Queries(q.ids[first], q.vectors[first])
        shared = spark.sparkContext.broadcast(queries)
        lists = v.mapInArrow(_local_lists(shared, k, id_col, vec_col, scale), "d int, q int, low double")
        order = Window.partitionBy("d", "q").orderBy(F.col("low").desc())
        cut = lists.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("d", "q").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).collect()
        for q in queries.values():
            q.cutoff = np.full(len(q.ids), -np.inf)
        for r in cut:
            queries[r["d"]].cutoff[r["q"]] = r["low"]
        shared = spark.sparkContext.broadcast(queries)
        entries = v.mapInArrow(_sufficient(shared, k, id_col, vec_col, scale), "query_id long, vec_id long, score long")
        rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        top = entries.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            top = written(top, "topk")
        found = top if found is None else found.unionByName(top)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
