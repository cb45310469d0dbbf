"""Event streams: sessions, windows, quotas, limits, deduplication and health, each in a streaming and a batch form.

The streaming forms work on any streaming DataFrame with a watermark; the batch forms give the same rows for data that is
all there, and tests compare the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, start, end, n): sessions that end after `gap` without an event. Batch and streaming alike."""
    s = events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, key: str, at: str, width: str, value: str) -> DataFrame:
    """(key, start, n, total): epoch-aligned windows. Batch and streaming alike."""
    s = events.groupBy(key, F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return s.select(key, F.col("w.start").alias("start"), "n", "total")


def sliding(events: DataFrame, key: str, at: str, width: str, step: str) -> DataFrame:
    s = events.groupBy(key, F.window(at, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, ident: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """First arrival of every id; a stream forgets ids once the watermark has passed them."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(ident) if events.isStreaming else events.dropDuplicates(ident)


def within_last(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Adds recent: events of the key in the last `seconds`, this one included. Batch form of a sliding limit."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(w))


QUOTA_STATE = "started timestamp, used double"
LIMIT_STATE = "times array<long>"


def quota_step(state: tuple | None, at, amount: float, width: float, limit: float) -> tuple[tuple, bool]:
    """A window begins with its first use; an amount that would exceed the limit is refused and not counted."""
    start, used = state if state is not None else (at, 0.0)
    if (at - start).total_seconds() >= width:
        start, used = at, 0.0
    if used + amount > limit:
        return (start, used), False
    return (start, used + amount), True


def limit_step(times: list, now: int, long: tuple[int, int], burst: tuple[int, int]) -> tuple[list, bool]:
    """Sliding limits (seconds, calls) over a long and a burst span; refused calls are not counted. Times in microseconds."""
    times = [t for t in times if t > now - long[0] * 1_000_000]
    if len(times) >= long[1] or sum(t > now - burst[0] * 1_000_000 for t in times) >= burst[1]:
        return times, False
    return [*times, now], True


def quota(events: DataFrame, key: str, at: str, amount: str, ident: str, width: float, limit: float) -> DataFrame:
    """(key, id, allowed): exact quota windows anchored at first use; a group is one key's events in time order."""
    kind = events.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{ident}` long, allowed boolean"

    def batch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values([at, ident]), None, []
        for t, a in zip(pdf[at], pdf[amount], strict=True):
            state, ok = quota_step(state, t, a, width, limit)
            out.append(ok)
        return pdf[[key, ident]].assign(allowed=out)

    def stream(k: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        state = store.get if store.exists else None
        for pdf in frames:
            pdf, out = pdf.sort_values([at, ident]), []
            for t, a in zip(pdf[at], pdf[amount], strict=True):
                state, ok = quota_step(state, t, a, width, limit)
                out.append(ok)
            yield pdf[[key, ident]].assign(allowed=out)
        if state is not None:
            store.update(state)

    if events.isStreaming:
        return events.groupBy(key).applyInPandasWithState(stream, schema, QUOTA_STATE, "append", GroupStateTimeout.NoTimeout)
    return events.select(key, ident, at, amount).groupBy(key).applyInPandas(batch, schema)


def rate_limit(events: DataFrame, key: str, at: str, ident: str, long: tuple[int, int] = (60, 30), burst: tuple[int, int] = (5, 10)) -> DataFrame:
    """(key, id, allowed): 30 calls a minute and 10 in five seconds per key, refused calls not counted."""
    kind = events.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{ident}` long, allowed boolean"

    def decide(pdf: pd.DataFrame, times: list) -> tuple[pd.DataFrame, list]:
        pdf, out = pdf.sort_values([at, ident]), []
        for t in pdf[at]:
            times, ok = limit_step(times, int(t.value // 1000), long, burst)
            out.append(ok)
        return pdf[[key, ident]].assign(allowed=out), times

    def stream(k: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        times = list(store.get[0]) if store.exists else []
        for pdf in frames:
            out, times = decide(pdf, times)
            yield out
        store.update((times,))

    if events.isStreaming:
        return events.groupBy(key).applyInPandasWithState(stream, schema, LIMIT_STATE, "append", GroupStateTimeout.NoTimeout)
    return events.select(key, ident, at).groupBy(key).applyInPandas(lambda pdf: decide(pdf, [])[0], schema)


#: Seconds a provider stays out after each kind of failure (fixed values).
COOLDOWN = {"timeout": 10, "rate_limited": 30, "server_error": 15, "auth_error": 30, "unknown": 5}


def health(events: DataFrame, key: str, at: str, kind: str, ident: str) -> DataFrame:
    """Adds out_until and available: a failure keeps its key out for the kind's cooldown; the latest failure before decides."""
    seconds = F.create_map(*[F.lit(x) for kv in COOLDOWN.items() for x in kv])[F.col(kind)]
    until = F.when(seconds.isNotNull(), F.timestamp_micros(F.unix_micros(F.col(at).cast("timestamp")) + seconds * 1_000_000).cast(events.schema[at].dataType))
    w = Window.partitionBy(key).orderBy(at, ident).rowsBetween(Window.unboundedPreceding, -1)
    out = events.withColumn("_u", until).withColumn("out_until", F.max("_u").over(w)).drop("_u")
    return out.withColumn("available", F.col("out_until").isNull() | (F.col(at) >= F.col("out_until")))


def gain(events: DataFrame, key: str, step: str, item: str) -> DataFrame:
    """(key, step, found, new, known, gain, empty_run): items new at each step over those known before, and how many steps in a row had none."""
    first = events.groupBy(key, item).agg(F.min(step).alias("_f"))
    steps = events.groupBy(key, step).agg(F.countDistinct(item).alias("found"))
    new = first.groupBy(key, F.col("_f").alias(step)).agg(F.count(F.lit(1)).alias("new"))
    w = Window.partitionBy(key).orderBy(step)
    s = steps.join(new, [key, step], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    s = s.withColumn("known", F.coalesce(F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("gain", F.when(F.col("known") > 0, F.col("new") / F.col("known")).otherwise(F.when(F.col("new") > 0, 1.0).otherwise(0.0)))
    s = s.withColumn("_island", F.count_if(F.col("new") > 0).over(w))
    run = F.row_number().over(Window.partitionBy(key, "_island").orderBy(step)) - F.when(F.col("_island") > 0, 1).otherwise(0)
    return s.withColumn("empty_run", F.when(F.col("new") > 0, 0).otherwise(run)).drop("_island")
