"""Exact dedup by a tree-merge of digest runs, merged by hash aggregation; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlight.llm.common import columns, written

#: Runs that one round merges into one: each round is FAN_BITS binomial exchanges at once.
FAN_BITS = 3


def digests(text: Column) -> list[Column]:
    """The identity of a text: SHA-256, and a second hash and the length that verify it at every level."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("_check"), F.octet_length(text).cast("long").alias("_bytes")]


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """(text_sha256, _check, _bytes, keep_id, group_size) per distinct text.

    A run is one partition's distinct digests, with the best identifier and the number of rows of each: what the partial
    aggregate makes before it exchanges. Runs are merged by hash, not in sorted order. In each round runs whose numbers agree but for the next FAN_BITS bits
    merge; after the last round one run, spread by digest over all tasks, is left. Only digests, identifiers and counts
    move, and a group of copies arrives as one row per run and round however many rows it has.
    """
    best = F.max if keep == "largest" else F.min
    key = ["text_sha256", "_check", "_bytes"]
    runs = docs.select(*digests(docs[text_col]), docs[id_col].alias("keep_id"), F.spark_partition_id().alias("_run"))
    out = runs.groupBy("_run", *key).agg(best("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    n = max(1, len(docs.inputFiles()), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for _ in range(max(1, math.ceil(math.log2(n) / FAN_BITS))):
        out = out.groupBy(F.shiftright("_run", FAN_BITS).alias("_run"), *key).agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    # whatever the partitions' numbers were, this last exchange leaves one run
    return out.groupBy(*key).agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256), one row per row of docs.

    Texts are equal when identical as they are; null counts as empty. Of equal texts the largest id stays (keep='smallest':
    the smallest); a null id stays only if all of its group are null. Rows that repeat text and id are all marked kept if
    their id is: `distinct_documents` keeps one of them. Further columns are dropped; an empty table gives no row.
    """
    key = ["text_sha256", "_check", "_bytes"]
    # as a table, so that the join deals out both sides anew and can split the rows of a large group of copies
    groups = written(duplicate_groups(docs, id_col, text_col, keep), "groups")
    rows = columns(docs, id_col, text_col).select(F.col(id_col), *digests(F.col(text_col)))
    return rows.join(groups, key).select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs, all columns, whose id stays in its group of equal texts; exactly one row of each group is left.

    Of rows that repeat both text and id any one stays. Only if an id repeats at all are the kept rows shuffled for that.
    """
    d = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    key, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    groups = written(duplicate_groups(d, key, text, keep), "groups")
    rows = d.select(*digests(F.col(text)), *d.columns)
    same = [rows[c] == groups[c] for c in ("text_sha256", "_check", "_bytes")]
    out = rows.join(groups, [*same, rows[key].eqNullSafe(groups["keep_id"])], "left_semi")
    if not d.groupBy(key).count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["text_sha256", "_check", "_bytes"])
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
