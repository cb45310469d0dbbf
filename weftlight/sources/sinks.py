"""Sinks: staged writes that appear whole, upserts by checksum, partitioned index tables, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_whole(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write to a staging folder beside `path` and put it in place when all tasks are done; readers never see a part.

    A table that is there is moved aside first and deleted last: a failure between leaves it whole, under `path` again or, if
    the driver itself is lost, under `path`.before-… .
    """
    spark = df.sparkSession
    stage = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    w = df.write.format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(stage)
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(stage), jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.before-{uuid.uuid4().hex}")
    there = fs.exists(dst)
    if there and not fs.rename(dst, old):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(src, dst):
        if there:
            fs.rename(old, dst)
        raise OSError(f"{stage} could not be moved to {path}")
    if there:
        fs.delete(old, True)


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows of both by key: a row that exists keeps the columns of `keep` (its id, its creation time) and takes the others."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key]))).filter("_r = 1").drop("_r")
    o, n = old.alias("o"), first.alias("n")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep or c == key else F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*[pick(c).alias(c) for c in old.columns])


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Delete by id: what is left."""
    return df.join(ids.select(key), key, "left_anti")


def write_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings by term bucket, so that a lookup of few terms opens few folders."""
    write_whole(postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))), path, partition_by=["bucket"])


def read_index(spark: SparkSession, path: str, terms: list[str], buckets: int = 64) -> DataFrame:
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"))
    return spark.read.parquet(path).join(F.broadcast(wanted), ["bucket", "term"])


def read_back(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text): the chunks of a document in order, joined by a blank line."""
    return chunks.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def report(metrics: DataFrame) -> tuple[str, str]:
    """A small aggregated table as JSON lines and as a markdown table."""
    rows = [r.asDict() for r in metrics.collect()]
    head = metrics.columns
    md = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join("" if r[c] is None else str(r[c]) for c in head) + " |" for r in rows]]
    return "\n".join(json.dumps(r, default=str) for r in rows), "\n".join(md)
