"""Joins of streams within an interval, and sinks that take each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from weftlight.sources.snapshots import Change, Store


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, before: int, after: int, outer: bool = False) -> DataFrame:
    """Pairs of rows of one key where right_at is from `before` seconds before to `after` seconds after left_at.

    With outer, left rows without a partner appear once, the right columns null. Column names but the key must differ. Two
    streams need watermarks on both times: each side's state then goes when no partner can come any more, an unmatched left
    row is given when that is so, and rows later than their watermark join nothing. Over tables a left row lies in one bucket
    of time, as wide as the interval, and a right row in the at most two in which its partners lie, so a key with many rows
    is dealt out over its buckets. Null keys and times join nothing. Streams and tables give the same rows.
    """
    how = "left_outer" if outer else "inner"
    other = right.withColumnRenamed(key, "_key")
    if left.isStreaming or right.isStreaming:
        near = (left[key] == other["_key"]) & (other[right_at] >= left[left_at] - F.expr(f"interval {before} seconds")) & (other[right_at] <= left[left_at] + F.expr(f"interval {after} seconds"))
        return left.join(other, near, how).drop("_key")
    width = (before + after) * 1_000_000 + 1
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda x: F.floor(x / F.lit(width)).cast("long")
    low, high = micros(right_at) - after * 1_000_000, micros(right_at) + before * 1_000_000
    dealt = left.withColumns({"_b": bucket(micros(left_at)), "_l": micros(left_at)})
    spread = other.filter(F.col(right_at).isNotNull()).withColumns({"_from": low, "_to": high, "_c": F.explode(F.array_distinct(F.array(bucket(low), bucket(high))))})
    met = dealt.join(spread, (F.col(key) == F.col("_key")) & (F.col("_b") == F.col("_c")) & F.col("_l").between(F.col("_from"), F.col("_to")), how)
    return met.select(*left.columns, *[c for c in right.columns if c != key])


def committed(stream: DataFrame, store: Store, table: str, writer: str) -> DataStreamWriter:
    """A writer of the stream that adds each batch to a table of the store, exactly once.

    The batch's number goes into the same commit as its rows. A batch that is run again, because the query stopped between the
    commit and its own record of it, finds its number there and adds nothing. Start it with a checkpointLocation; a query of
    another checkpoint needs another writer name.
    """

    def add(rows: DataFrame, n: int) -> None:
        if store.manifest().writers.get(writer, -1) >= n:
            rows.write.format("noop").mode("overwrite").save()  # nothing to add, but the query's own state has to go on
        else:
            store.commit({table: Change(rows)}, writer=(writer, n))

    return stream.writeStream.foreachBatch(add)
