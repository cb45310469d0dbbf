"""Property graph: node and edge tables, merges, traversal hop by hop, context, statistics, change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, kind): largest confidence, number of records."""
    return edges.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_records"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: sum of mentions, largest confidence, the longest description (ties: the smallest)."""
    return nodes.groupBy("id").agg(F.sum("mentions").alias("mentions"), F.max("confidence").alias("confidence"), F.min_by("description", F.struct(-F.length("description"), F.col("description"))).alias("description"))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, decay: float = 0.8, both_ways: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """(seed, node, hop, score): nodes reached within `hops`, each at its first hop with the best confidence * decay^hop.

    Out-edges only unless both_ways. One join per hop between the frontier and the edges; visited nodes leave by an
    anti-join, so cycles end. hops is small (four at most in practice) and bounds the plan.
    """
    e = edges.select("src", "dst", "kind", "confidence")
    if kinds:
        e = e.filter(F.col("kind").isin(kinds))
    if both_ways:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "confidence"))
    e = e.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"), F.lit(1.0).alias("score"))
    front = seen
    for h in range(1, hops + 1):
        step = front.select("seed", F.col("node").alias("src")).join(e, "src").groupBy("seed", F.col("dst").alias("node")).agg(F.max("confidence").alias("_c"))
        front = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(h).alias("hop"), (F.col("_c") * decay**h).alias("score"))
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop, path): one shortest path to each node; of equal ones the smallest."""
    out = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"), F.array(F.col("seed")).alias("path"))
    front = out
    e = edges.select("src", "dst").distinct()
    for h in range(1, hops + 1):
        step = front.select("seed", F.col("node").alias("src"), "path").join(e, "src").select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = step.groupBy("seed", "node").agg(F.min("path").alias("path")).join(out.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(h).alias("hop"), "path")
        out = out.unionByName(front)
    return out


def context(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in, kinds): degree of every node in both directions."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), "kind").unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), "kind"))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.countDistinct("kind").alias("kinds"))


def temporal_edges(edges: DataFrame, start: str, end: str) -> DataFrame:
    """Edges not known to begin before `start` or to end after `end`; null bounds pass."""
    return edges.filter((F.col("valid_from").isNull() | (F.col("valid_from") >= F.lit(start).cast("timestamp"))) & (F.col("valid_to").isNull() | (F.col("valid_to") <= F.lit(end).cast("timestamp"))))


def change_log(changes: DataFrame, target: str, at: str, ident: str) -> DataFrame:
    """Adds sequence (per target, in time order), is_current and valid_to (the next change's time)."""
    w = Window.partitionBy(target).orderBy(at, ident)
    return changes.withColumn("sequence", F.row_number().over(w)).withColumn("valid_to", F.lead(at).over(w)).withColumn("is_current", F.lead(F.lit(1)).over(w).isNull())
