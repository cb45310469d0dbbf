"""The health machine: stream, table and a plain walk give the same rows."""

import random
from datetime import datetime, timedelta

import pytest

from weftlight.streaming import health

T0 = datetime(2024, 1, 1)
KINDS = "provider string, model string, at timestamp, ident long, code string, scope string"


def calls(seed, n, span):
    rng = random.Random(seed)
    codes = [None, None, "RATE_LIMIT_ERROR", "QUOTA_EXHAUSTED", "PROVIDER_UNAVAILABLE", "AUTHENTICATION_ERROR", "odd", "CALL_CEILING_EXCEEDED"]
    return [(rng.choice("ab"), rng.choice(["m", "n", None]), T0 + timedelta(seconds=rng.choice([rng.randrange(span), rng.random() * span])), i, rng.choice(codes), rng.choice(["model", "provider"])) for i in range(n)]


def walk(rows, idle):
    """The rules, one outcome after another."""
    out, by = [], {}
    for p, m, at, i, code, scope in rows:
        if code != "CALL_CEILING_EXCEEDED":
            by.setdefault(p if scope == "provider" or m is None else f"{p}/{m}", []).append((at, i, code))
    for e, events in by.items():
        until, failures, last = None, 0, None
        for at, i, code in [*sorted(events, key=lambda r: r[:2]), (datetime(2100, 1, 1), 0, "end")]:
            if until and until <= at:
                out.append((e, until, None, "healthy", None, failures))
                until = None
            if code == "end":
                continue
            failures = 0 if last and at - last > timedelta(seconds=idle) else failures
            last = at
            if code:
                status, seconds = health.STATES.get(code, health.OTHER)
                until, failures = at + timedelta(seconds=seconds), failures + 1
                out.append((e, at, i, status, until, failures))
            else:
                if until:
                    out.append((e, at, i, "healthy", None, 0))
                until, failures = None, 0
    return out


def key(r):
    return tuple((x is None, str(x)) for x in r)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


@pytest.mark.parametrize(("seed", "n", "span"), [(1, 300, 600), (2, 200, 40), (3, 5, 5000)])
def test_table_equals_the_walk(spark, seed, n, span):
    rows = calls(seed, n, span)
    seen = health.outcomes(spark.createDataFrame(rows, KINDS), "provider", "model", "at", "ident", "code", "scope")
    assert plain(health.health_changes(seen, 60)) == sorted(walk(rows, 60), key=key)
    assert health.health_changes(seen.limit(0)).count() == 0


def test_stream_equals_the_walk_and_drops_what_is_late(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = calls(4, 240, 600)
    rows.sort(key=lambda r: (r[2] + timedelta(seconds=random.Random(r[3]).random() * 25)))  # arrives up to 25 seconds out of order
    late = ("a", "m", T0 + timedelta(seconds=1), 900, "odd", "model")
    end = ("zz", None, T0 + timedelta(days=2), 901, None, "provider")
    parts = [rows[:80], rows[80:160], [*rows[160:], late], [end]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, KINDS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    seen = health.outcomes(source, "provider", "model", "at", "ident", "code", "scope").withWatermark("at", "30 seconds")
    stream = health.health_changes(seen, 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append")
    try:
        for _ in range(2):  # the second start finds nothing new and gives no row twice
            q = stream.start()
            q.processAllAvailable()
            q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == sorted(walk(rows, 60), key=key)


def test_routing_asks_the_provider_first(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [("a", "m", at(0), 1, "RATE_LIMIT_ERROR", "model"), ("a", None, at(2), 2, "odd", "provider"), ("b", "m", at(0), 3, "QUOTA_EXHAUSTED", "model"), ("b", "m", at(4), 4, None, "model")]
    changes = health.health_changes(health.outcomes(spark.createDataFrame(rows, KINDS), "provider", "model", "at", "ident", "code", "scope"))
    asks = [(1, "a", "m", at(1)), (2, "a", "m", at(3)), (3, "a", "n", at(3)), (4, "a", "n", at(1)), (5, "a", "m", at(8)), (6, "a", "m", at(10)), (7, "b", "m", at(3)), (8, "b", "m", at(4)), (9, "c", None, at(4)), (10, None, "m", at(4)), (11, "a", "m", None)]
    requests = spark.createDataFrame(asks, "id long, p string, m string, t timestamp")
    got = {r["id"]: (r["reason"], r["remaining"]) for r in health.routing(requests, changes, "p", "m", "t", "id").collect() if r["blocked"]}
    assert got == {1: ("rate_limited", 9.0), 2: ("unavailable", 4.0), 3: ("unavailable", 4.0), 5: ("rate_limited", 2.0), 7: ("quota_exhausted", 27.0)}
    probes = spark.createDataFrame([(1, 1, "a", "m", at(8.5)), (1, 2, "b", "m", at(3.5)), (2, 3, "a", "m", at(1)), (3, 4, "a", None, at(6))], "g int, i long, p string, m string, t timestamp")
    assert plain(health.recovery_probes(probes, changes, "g", "p", "m", "t", "i")) == [(1, 1, 1.5), (3, 4, 1.0)]
