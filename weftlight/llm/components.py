"""Connected components by repeated contraction; edges and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlight.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is one node of its component, the same for all of it.

    Each round points every node at its smallest neighbour if that is smaller, follows the pointers, and keeps one copy of
    the edges between different targets. Every node but the local minima goes away, so rounds are logarithmic in the
    longest chain and edges shrink. Hubs only meet aggregates with partial minima and joins that AQE can split. A round's
    tables are deleted when the next one's are written. Repeated edges and edges from a node to itself change nothing; no
    edges give no row.
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(left.select(F.col("b").alias("u"), F.col("a").alias("v")))
    names = None
    while not left.isEmpty():
        point = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        nearest = point = written(point, "point")
        for _ in range(2):
            further = point.select(F.col("u").alias("p"), F.col("p").alias("q"))
            point = point.join(further, "p").select("u", F.col("q").alias("p"))
        point = written(point, "point")
        before = names
        names = point.select(F.col("u").alias("node"), F.col("p").alias("root")) if names is None else names.join(point.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        names = written(names, "names")
        a = left.join(point.select(F.col("u").alias("a"), F.col("p").alias("x")), "a").select("b", "x")
        ab = a.join(point.select(F.col("u").alias("b"), F.col("p").alias("y")), "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        done, left = left, written(ab.distinct(), "edges")
        discard(done, nearest, point, *([before] if before is not None else []))
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(left.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return names if names is not None else left.sparkSession.createDataFrame([], "node long, root long")
