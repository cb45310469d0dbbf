"""Health of providers and models: a state per entity that failures set, successes clear and time heals.

An entity is a provider, or a model of one ("provider/model"). An outcome is a row of a call: provider, model, when, a code
(null: success) and the scope it speaks for. `health_changes` gives the same rows over a stream, with a timer for every
cooldown, and over a table, with windows; `routing` asks what a request at some time may use.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Status and seconds of cooldown by error code, and of all other codes (fixed values).
STATES = {
    "RATE_LIMIT_ERROR": ("rate_limited", 10),
    "QUOTA_EXHAUSTED": ("quota_exhausted", 30),
    "TIMEOUT_OR_NETWORK_ERROR": ("unavailable", 15),
    "PROVIDER_UNAVAILABLE": ("unavailable", 15),
    "AUTHENTICATION_ERROR": ("unavailable", 30),
    "CONFIGURATION_ERROR": ("unavailable", 30),
    "CAPABILITY_NOT_SUPPORTED": ("unavailable", 30),
}
OTHER = ("degraded", 5)
#: Codes that say nothing about an entity's health (fixed values).
IGNORED = ("CALL_CEILING_EXCEEDED",)
#: A recovery is probed when its cooldown ends within so many seconds.
PROBE_SECONDS = 2.0


def entity(provider: Column, model: Column, scope: Column) -> Column:
    """The entity an outcome speaks for: the model if the scope is "model" and there is one, else the provider."""
    return F.when((scope == "provider") | model.isNull(), provider.cast("string")).otherwise(F.concat_ws("/", provider.cast("string"), model.cast("string")))


def _table(place: int) -> Column:
    return F.create_map(*[F.lit(x) for code, v in STATES.items() for x in (code, v[place])])


def outcomes(calls: DataFrame, provider: str, model: str, at: str, ident: str, code: str, scope: str, unit: float = 1.0) -> DataFrame:
    """(entity, at, ident, failed, status, seconds): what each call says; rows without time and codes of IGNORED are left out.

    unit stretches the cooldowns: 1.0 is seconds as in STATES.
    """
    c = F.col(code)
    rows = calls.filter(F.col(at).isNotNull() & (c.isNull() | ~c.isin(*IGNORED)))
    return rows.select(
        entity(F.col(provider), F.col(model), F.col(scope)).alias("entity"),
        F.col(at).cast("timestamp").alias("at"),
        F.col(ident).cast("long").alias("ident"),
        c.isNotNull().alias("failed"),
        F.when(c.isNull(), "healthy").otherwise(F.coalesce(_table(0)[c], F.lit(OTHER[0]))).alias("status"),
        F.when(c.isNull(), 0.0).otherwise(F.coalesce(_table(1)[c], F.lit(OTHER[1])) * unit).cast("double").alias("seconds"),
    )


CHANGES = "entity string, at timestamp, ident long, status string, until timestamp, failures int"


class Entity(StatefulProcessor):
    """One entity's health in event time.

    Outcomes wait until the watermark has passed them and are then taken in order of time and ident, whatever order they
    came in; a cooldown's end is a timer of its own. An entity that has been silent for `idle` seconds is forgotten.
    """

    def __init__(self, idle: float):
        self.idle = int(idle * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, ident long, failed boolean, status string, seconds double")
        self.health = handle.getValueState("health", "status string, until long, failures int, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            at = pdf["at"].astype("datetime64[us]").astype("int64").tolist()
            self.waiting.appendList([(t, int(i), bool(f), s, float(x)) for t, i, f, s, x in zip(at, pdf["ident"], pdf["failed"], pdf["status"], pdf["seconds"], strict=True)])
            for t in set(at):
                self._wake(t)
        return iter(())

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        status, until, failures, last = self.health.get() if self.health.exists() else ("healthy", 0, 0, 0)
        out = []
        for at, ident, failed, new, seconds in due:
            if until and until <= at:
                out.append((until, None, "healthy", None, failures))
                status, until = "healthy", 0
            if last and at - last > self.idle:
                failures = 0
            if failed:
                failures, status, until = failures + 1, new, at + round(seconds * 1_000_000)
                out.append((at, ident, status, until, failures))
                self._wake(until)
            else:
                if status != "healthy":
                    out.append((at, ident, "healthy", None, 0))
                failures, status, until = 0, "healthy", 0
            last = at
        if due:
            self._wake(last + self.idle + 1)
        if until and until <= now:
            out.append((until, None, "healthy", None, failures))
            status, until = "healthy", 0
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if not rest and not until and last + self.idle < now:
            self.health.clear()
        else:
            self.health.update((status, until, failures, last))
        if out:
            moment = [datetime.fromtimestamp(0, timezone.utc) + pd.Timedelta(microseconds=r[0]) for r in out]
            ends = [None if r[3] is None else datetime.fromtimestamp(0, timezone.utc) + pd.Timedelta(microseconds=r[3]) for r in out]
            yield pd.DataFrame({"entity": key[0], "at": pd.to_datetime(moment, utc=True), "ident": pd.array([r[1] for r in out], "Int64"), "status": [r[2] for r in out], "until": pd.to_datetime(pd.Series(ends, dtype="object"), utc=True), "failures": pd.array([r[4] for r in out], "Int32")})

    def close(self) -> None:
        pass


def health_changes(seen: DataFrame, idle: float = 3600.0) -> DataFrame:
    """(entity, at, ident, status, until, failures): every failure, the end of each cooldown that no outcome overtook
    (ident null), and every success that ends one early.

    seen: rows of `outcomes`. failures counts the entity's failures since its last success, or since a silence of more than
    idle seconds. The latest failure decides status and cooldown, whatever was there before. At one instant the smaller
    ident comes first; a cooldown that ends at an outcome's time has ended. A stream needs a watermark on `at` and the
    RocksDB state store; it gives a row once the watermark has passed it, and drops outcomes that come later than that.
    An empty table gives no row.
    """
    if seen.isStreaming:
        return seen.groupBy("entity").transformWithStateInPandas(Entity(idle), CHANGES, "Append", "EventTime")
    w = Window.partitionBy("entity").orderBy("at", "ident")
    micros = F.unix_micros("at")
    s = seen.withColumn("until", F.when(F.col("failed"), F.timestamp_micros(micros + F.round(F.col("seconds") * 1_000_000).cast("long"))))
    s = s.withColumns({"after": F.lead("at").over(w), "was": F.lag("until").over(w), "silent": micros - F.lag(micros).over(w) > int(idle * 1_000_000)})
    s = s.withColumn("run", F.sum((~F.col("failed") | F.coalesce("silent", F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("failures", F.sum(F.col("failed").cast("int")).over(Window.partitionBy("entity", "run").orderBy("at", "ident").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    kept = s.filter("failed or was > at").select("entity", "at", "ident", "status", "until", "failures")
    healed = s.filter("failed and (after is null or until <= after)").select("entity", F.col("until").alias("at"), F.lit(None).cast("long").alias("ident"), F.lit("healthy").alias("status"), F.lit(None).cast("timestamp").alias("until"), "failures")
    return kept.unionByName(healed)


def routing(requests: DataFrame, changes: DataFrame, provider: str, model: str, at: str, ident: str) -> DataFrame:
    """(ident, blocked, reason, remaining): whether a request may use its model at its time.

    The provider's health is asked first, then the model's; the latest change at or before the request decides. reason is
    quota_exhausted, rate_limited or, for any other state, unavailable; remaining is in seconds. Requests and changes of an
    entity meet in time order by a window, so each request costs two rows, not a range join. A request of a null time or
    provider is not blocked. Requests need unique idents.
    """
    asked = requests.select(F.col(ident).alias("request"), F.col(at).cast("timestamp").alias("at"), F.col(provider).cast("string").alias("p"), F.col(model).cast("string").alias("m"))
    asked = asked.select("request", "at", F.posexplode(F.array("p", F.when(F.col("m").isNotNull(), F.concat_ws("/", "p", "m")))).alias("turn", "entity")).filter("entity is not null and at is not null")
    state = changes.select("entity", "at", F.lit(None).cast(asked.schema["request"].dataType).alias("request"), F.lit(None).cast("int").alias("turn"), F.struct("status", "until").alias("state"), F.lit(0).alias("rank"), F.coalesce("ident", F.lit(-(1 << 62))).alias("ident"))
    both = state.unionByName(asked.select("entity", "at", "request", "turn", F.lit(None).cast(state.schema["state"].dataType).alias("state"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("ident")))
    w = Window.partitionBy("entity").orderBy("at", "rank", "ident").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("state", F.last("state", ignorenulls=True).over(w)).filter("request is not null and state.until > at")
    first = known.groupBy("request").agg(F.min(F.struct("turn", F.col("state.status").alias("status"), ((F.unix_micros("state.until") - F.unix_micros("at")) / 1e6).alias("remaining"))).alias("s"))
    reason = F.when(F.col("s.status").isin("quota_exhausted", "rate_limited"), F.col("s.status")).when(F.col("s").isNotNull(), "unavailable")
    return requests.select(F.col(ident).alias("request")).join(first, "request", "left").select(F.col("request").alias(ident), F.col("s").isNotNull().alias("blocked"), reason.alias("reason"), F.col("s.remaining").alias("remaining"))


def recovery_probes(candidates: DataFrame, changes: DataFrame, group: str, provider: str, model: str, at: str, ident: str, grace: float = PROBE_SECONDS) -> DataFrame:
    """(group, ident, remaining): of each group of candidates the one in cooldown whose own cooldown ends first, within grace.

    A candidate is asked about by its own entity only. Equal ends go to the smaller ident. Groups without such a candidate
    give no row, so what is still far from healing is not probed.
    """
    own = candidates.select(group, F.col(ident).alias("_i"), F.col(at).alias("_at"), entity(F.col(provider), F.col(model), F.lit("model")).alias("_e"))
    asked = routing(own.withColumn("_m", F.lit(None).cast("string")), changes, "_e", "_m", "_at", "_i").filter(F.col("blocked") & (F.col("remaining") <= grace))
    return own.join(asked, "_i").groupBy(group).agg(F.min(F.struct("remaining", "_i")).alias("s")).select(group, F.col("s._i").alias(ident), F.col("s.remaining").alias("remaining"))
