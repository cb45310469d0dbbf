"""Fusion of two ranked channels, and merges of evidence from several methods or needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def channels(lexical: DataFrame, dense: DataFrame, question: str, item: str) -> DataFrame:
    """(question, item, bm25, cosine, rank_b, rank_v, n_b, n_v): full outer join of two channels with ranks from 1."""
    both = lexical.select(question, item, F.col("score").alias("bm25")).join(dense.select(question, item, F.col("score").alias("cosine")), [question, item], "full_outer")
    q = Window.partitionBy(question)
    rank = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(q.orderBy(F.col(c).desc_nulls_last(), item)))
    return both.select("*", rank("bm25").alias("rank_b"), rank("cosine").alias("rank_v"), F.count("bm25").over(q).alias("n_b"), F.count("cosine").over(q).alias("n_v"), F.count(F.lit(1)).over(q).alias("n"))


def weights(w_b: float, w_v: float) -> tuple[float, float]:
    """Weights that sum to one; half each if both are zero."""
    t = w_b + w_v
    return (0.5, 0.5) if t == 0 else (w_b / t, w_v / t)


def _over(question: str, c: Column) -> Column:
    return c.over(Window.partitionBy(question))


def score(kind: str, question: str, w_b: float = 0.5, w_v: float = 0.5) -> Column:
    """The fused score over channels(); an item that a channel lacks counts as each rule has it."""
    w_b, w_v = weights(w_b, w_v)
    b, v, n = F.coalesce("bm25", F.lit(0.0)), F.coalesce("cosine", F.lit(0.0)), F.col("n")
    top_b = _over(question, F.max(b))
    if kind == "max":  # the lexical channel by its maximum, the cosine as it is
        return w_b * F.when(top_b > 0, b / top_b).otherwise(0.0) + w_v * v
    if kind == "rank":  # linear in the rank; a missing item has the last rank, which is worth 1/n
        return w_b * (n - F.coalesce("rank_b", n) + 1) / n + w_v * (n - F.coalesce("rank_v", n) + 1) / n
    if kind == "max_of_both":
        return F.greatest(1 / F.coalesce("rank_b", F.lit(100)), 1 / F.coalesce("rank_v", F.lit(100)))
    if kind == "rrf":
        return 1 / (60 + F.coalesce("rank_b", F.col("n_b") + 1)) + 1 / (60 + F.coalesce("rank_v", F.col("n_v") + 1))
    if kind == "sum_norm":
        s_b, s_v = _over(question, F.sum(b)), _over(question, F.sum(v))
        return w_b * F.when(s_b > 0, b / s_b).otherwise(0.0) + w_v * F.when(s_v > 0, v / s_v).otherwise(0.0)
    if kind == "borda":
        return F.coalesce((n - F.col("rank_b") + 1) / n, F.lit(0.0)) + F.coalesce((n - F.col("rank_v") + 1) / n, F.lit(0.0))
    if kind == "dense_sparse":  # both channels by their maxima
        top_v = _over(question, F.max(v))
        return w_b * F.when(top_b > 0, b / top_b).otherwise(0.0) + w_v * F.when(top_v > 0, v / top_v).otherwise(0.0)
    raise ValueError(kind)


STRATEGIES = ("max", "rank", "max_of_both", "rrf", "sum_norm", "borda", "dense_sparse")


def fuse(frame: DataFrame, kind: str, question: str, item: str, k: int, w_b: float = 0.5, w_v: float = 0.5, digits: int = 8) -> DataFrame:
    """(question, item, fused, rank): the k best by the fused score, ties to the smaller item."""
    s = frame.select(question, item, F.round(score(kind, question, w_b, w_v).cast("double"), digits).alias("fused"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(question).orderBy(F.col("fused").desc(), item))).filter(F.col("rank") <= k)


def merge_methods(hits: DataFrame, question: str, item: str) -> DataFrame:
    """(question, item, score, method) from (question, item, method, weight, score): the best score/maximum*weight of each item."""
    top = F.max("score").over(Window.partitionBy(question, "method"))
    w = hits.withColumn("value", F.when(top > 0, F.col("score") / top * F.col("weight")).otherwise(0.0))
    return w.groupBy(question, item).agg(F.max("value").alias("score"), F.max_by("method", F.struct("value", "method")).alias("method"))


def merge_evidence(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row per item with its best score and how often it was found."""
    return hits.groupBy(*keys).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("times_found"))


def merge_needs(hits: DataFrame, need: str, item: str) -> DataFrame:
    """(item, owner, score, shared): the first need that finds an item owns it; later finds lift its score."""
    return hits.groupBy(item).agg(F.min(need).alias("owner"), F.max("score").alias("score"), (F.countDistinct(need) > 1).alias("shared"))


def fuse_by_pattern(frame: DataFrame, patterns: DataFrame, table: DataFrame, question: str, item: str, k: int, digits: int = 8) -> DataFrame:
    """(question, item, pattern, fused, rank): max fusion with the weights (pattern, w_b, w_v) of each question's pattern, half each where it has none."""
    b = F.coalesce("bm25", F.lit(0.0))
    top = F.max(b).over(Window.partitionBy(question))
    j = frame.join(patterns, question).join(F.broadcast(table), "pattern", "left")
    s = F.coalesce("w_b", F.lit(0.5)) * F.when(top > 0, b / top).otherwise(0.0) + F.coalesce("w_v", F.lit(0.5)) * F.coalesce("cosine", F.lit(0.0))
    r = j.select(question, item, "pattern", F.round(s, digits).alias("fused"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(question).orderBy(F.col("fused").desc(), item))).filter(F.col("rank") <= k)
