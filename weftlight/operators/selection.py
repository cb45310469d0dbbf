"""Choosing evidence: diversification, near-duplicate removal, token budget, neighbours, versions, layers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlight.operators.numbering import numbered

#: Rows of a group up to which Spark cuts ranked groups before their shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
MOST_RANKED = 1000


def _rank(group: list[str], *order) -> F.Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order))


def diversify(hits: DataFrame, group: list[str], source: str, item: str, k: int) -> DataFrame:
    """k rows per group: the best of every source first, then the best of the rest; ranked by score again."""
    lead = hits.withColumn("_lead", _rank([*group, source], F.col("score").desc(), item) > 1)
    kept = lead.withColumn("_r", _rank(group, "_lead", F.col("score").desc(), item)).filter(F.col("_r") <= k)
    return kept.drop("_lead", "_r").withColumn("rank", _rank(group, F.col("score").desc(), item))


def diversify_if_narrow(hits: DataFrame, group: list[str], source: str, item: str, k: int, least_sources: int = 2) -> DataFrame:
    """The k best rows of each group, or diversify() for groups whose k best have fewer than least_sources sources."""
    plain = hits.withColumn("rank", _rank(group, F.col("score").desc(), item)).filter(F.col("rank") <= k)
    spread = plain.groupBy(*group).agg(F.countDistinct(source).alias("_n"))
    wide = plain.join(spread.filter(F.col("_n") >= least_sources).drop("_n"), group, "left_semi")
    narrow = hits.join(spread.filter(F.col("_n") < least_sources).drop("_n"), group, "left_semi")
    return wide.unionByName(diversify(narrow, group, source, item, k).select(*wide.columns))


def token_budget(hits: DataFrame, group: list[str], item: str, tokens: str, budget: int, least: int = 1) -> DataFrame:
    """Rows of each group from the best down while their tokens fit the budget; at least `least` rows stay.

    Dropping the lowest scores until the total fits keeps exactly the longest prefix that fits.
    """
    w = Window.partitionBy(*group).orderBy(F.col("score").desc(), item)
    r = hits.withColumn("running_tokens", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w))
    return r.filter((F.col("running_tokens") <= budget) | (F.col("rank") <= least))


def near_duplicates_removed(hits: DataFrame, group: list[str], item: str, vec_col: str = "embedding", threshold: float = 0.85) -> DataFrame:
    """hits without rows whose cosine with a better kept row of the group is `threshold` or more; rows without vector stay.

    The greedy choice depends on order, so each group (the hits of one question: k rows at most) is one grouped call.
    """
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", item], ascending=[False, True])
        kept, vectors = [], []
        for i, v in zip(pdf.index, pdf[vec_col], strict=True):
            if v is None:
                kept.append(i)
                continue
            u = np.asarray(v, float)
            u = u / (np.sqrt((u * u).sum()) or 1.0)
            if not vectors or max(float(u @ x) for x in vectors) < threshold:
                kept.append(i)
                vectors.append(u)
        return pdf.loc[kept]

    return hits.groupBy(*group).applyInPandas(run, cols)


def neighbours(chunks: DataFrame, id_col: str = "doc_id", reach: int = 1) -> DataFrame:
    """Each chunk with the ordinals of its neighbours; null beyond either end."""
    w = Window.partitionBy(id_col).orderBy("ordinal")
    return chunks.select(id_col, "ordinal", F.lag("ordinal", reach).over(w).alias("previous"), F.lead("ordinal", reach).over(w).alias("next"))


def latest_versions(docs: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Each row's version number within its source, and whether it is the latest."""
    w = Window.partitionBy(source).orderBy(*order)
    return docs.withColumn("version", F.row_number().over(w)).withColumn("is_current", F.lead(F.lit(1)).over(w).isNull())


def layer_cap(memory: DataFrame, layer: str, cap: int, order: list[F.Column]) -> DataFrame:
    """The `cap` rows of each layer that come first in the order.

    Up to MOST_RANKED rows a layer are cut by every task before they are shuffled. With more, layers within the cap are left
    as they are, and the rows of the others are numbered by all executors, so that no task sorts a layer.
    """
    if cap <= MOST_RANKED:
        return memory.withColumn("_r", _rank([layer], *order)).filter(F.col("_r") <= cap).drop("_r")
    over = memory.groupBy(F.col(layer).alias("_l")).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > cap).select("_l")
    if over.isEmpty():
        return memory
    there = F.col(layer).eqNullSafe(F.col("_l"))
    ranked = numbered(memory.join(F.broadcast(over), there, "left_semi"), "_n", [layer, *order])
    first = ranked.groupBy(F.col(layer).alias("_l")).agg(F.min("_n").alias("_f"))
    kept = ranked.join(F.broadcast(first), there).filter(F.col("_n") - F.col("_f") < cap).select(*memory.columns)
    return memory.join(F.broadcast(over), there, "left_anti").unionByName(kept)


def supersede(memory: DataFrame, key: list[str], at: str, value: str, confidence: str, ident: str) -> DataFrame:
    """Adds `live`: fresh evidence archives the standing row of its key if it differs and is at least as confident.

    A weaker newcomer is itself not live. A row stands from its time on if no row of its key before it was surer, so what
    stands, and when it was replaced, follow from running maxima and sums over each key in time order. A missing confidence
    is never at least as sure, nor is anything as sure as it.
    """
    w = Window.partitionBy(*key).orderBy(F.col(at).asc_nulls_last(), F.col(ident).asc_nulls_last())
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    m = memory.withColumns({"_n": F.row_number().over(w), "_top": F.max(confidence).over(before), "_first": F.first(confidence).over(so_far)})
    m = m.withColumn("_takes", (F.col("_n") == 1) | F.coalesce(F.col("_first").isNotNull() & (F.col(confidence) >= F.col("_top")), F.lit(False)))
    m = m.withColumn("_standing", F.last(F.when(F.col("_takes"), F.struct(F.col(value).alias("v"))), ignorenulls=True).over(before))
    m = m.withColumn("_same", (F.col("_n") > 1) & F.col(value).eqNullSafe(F.col("_standing.v")))
    m = m.withColumn("_epoch", F.count_if(F.col("_takes") & ~F.col("_same")).over(so_far))
    live = (F.col("_takes") | F.col("_same")) & (F.col("_epoch") == F.max("_epoch").over(Window.partitionBy(*key)))
    return m.withColumn("live", live).select(*memory.columns, "live")
