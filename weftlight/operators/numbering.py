"""Contiguous ids over partitions: positions within sorted partitions, and a prefix sum of their sizes."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlight.sources.places import shared_folder

_LOCAL = (1 << 33) - 1


def numbered(rows: DataFrame, id_col: str, order: list[str], start: int = 1, partitions: int | None = None) -> DataFrame:
    """rows with id_col: start, start + 1, ... in the order of the columns of `order`, without a gap, by all executors.

    Rows are dealt out by ranges of the order, sorted in their partitions and written, so that what is counted is what is
    numbered. Then the sizes of the partitions, one number each, are summed up by the driver, and each partition adds where it
    begins. Equals row_number over the whole table where the order is total; of rows with equal values any comes first.
    Nulls come first. A column of that name is replaced; an empty table gives no row.
    """
    spark = rows.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    plain = rows.drop(id_col)
    place = shared_folder(spark, "numbered")
    plain.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(place)
    written = spark.read.parquet(place)
    part = F.shiftrightunsigned("_at", 33).alias("_part")
    sizes = sorted((r["_part"], r["count"]) for r in written.groupBy(part).count().collect())
    starts = zip((p for p, _ in sizes), accumulate((c for _, c in sizes), initial=start), strict=False)
    offsets = spark.createDataFrame(list(starts), "_part long, _start long")
    return written.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*plain.columns, (F.col("_start") + F.col("_at").bitwiseAND(_LOCAL)).alias(id_col))


def continued(rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Rows whose id_col is null get the ids after the largest there is, from 1 where there is none; the others stay as they are.

    Only rows without an id are dealt out and sorted. All columns are kept, in their order.
    """
    last = rows.agg(F.max(id_col)).first()[0]
    new = numbered(rows.filter(F.col(id_col).isNull()), id_col, order, (last or 0) + 1)
    return rows.filter(F.col(id_col).isNotNull()).unionByName(new.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]))
