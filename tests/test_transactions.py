"""Numbering, stream joins, exactly-once sinks, and the tables that change together."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftlight.operators.numbering import continued, numbered
from weftlight.operators.selection import supersede
from weftlight.sources import memory
from weftlight.sources.snapshots import Change, Store
from weftlight.streaming.joining import committed, interval_join

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_ids_are_contiguous_and_in_order(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice(["a", "b", None]), i, rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(7)
    got = [(r["k"], r["i"], r["n"]) for r in numbered(df, "n", ["k", "i"], start=11, partitions=partitions).orderBy("n").collect()]
    want = sorted(((k, i) for k, i, _ in rows), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert got == [(k, i, 11 + j) for j, (k, i) in enumerate(want)]
    assert numbered(df.limit(0), "n", ["k"]).count() == 0


def test_ids_go_on_after_the_largest(spark):
    df = spark.createDataFrame([(i, None if i % 3 else i // 3) for i in range(30)], "i long, index int")
    once = continued(df, "index", ["i"])
    assert once.schema["index"].dataType.simpleString() == "int"
    twice = continued(once.unionByName(spark.createDataFrame([(100, None), (99, None)], once.schema)), "index", ["i"])
    got = {r["i"]: r["index"] for r in twice.collect()}
    assert [got[i] for i in range(0, 30, 3)] == list(range(10)) and [got[i] for i in range(30) if i % 3] == list(range(10, 30)) and (got[99], got[100]) == (30, 31)
    assert sorted(r["index"] for r in continued(df.filter("index is null"), "index", ["i"]).collect()) == list(range(1, 21))


def plain_join(left, right, before, after, outer):
    out = []
    for k, i, t in left:
        met = [(k, i, t, j, u) for m, j, u in right if k is not None and m == k and u is not None and t is not None and -before <= (u - t).total_seconds() <= after]
        out += met or ([(k, i, t, None, None)] if outer else [])
    return sorted(out, key=str)


def sides(seed, n):
    rng = random.Random(seed)
    make = lambda m: [(rng.choice([1, 1, 2, None]), i, at(rng.randrange(300))) for i in range(m)]
    return make(n), make(n)


@pytest.mark.parametrize(("outer", "before", "after"), [(False, 10, 20), (True, 0, 7), (True, 5, 0), (False, 0, 0)])
def test_interval_join_of_tables(spark, outer, before, after):
    left, right = sides(1, 120)
    left, right = [*left, (1, 998, None)], [*right, (1, 999, None)]
    a, b = spark.createDataFrame(left, "k int, i long, t timestamp"), spark.createDataFrame(right, "k int, j long, u timestamp")
    assert sorted(map(tuple, interval_join(a, b, "k", "t", "u", before, after, outer).collect()), key=str) == plain_join(left, right, before, after, outer)


def test_interval_join_of_streams_into_a_store_without_a_row_twice(spark, tmp_path):
    left, right = sides(2, 60)
    far = at(100_000)
    for name, rows, kind in (("l", left, "k int, i long, t timestamp"), ("r", right, "k int, j long, u timestamp")):
        rows = sorted(rows, key=lambda r: r[2])
        late = [(1, 500, at(0))]  # comes when the watermark is beyond it
        for i, part in enumerate((rows[:30], rows[30:], [(9, 900, far)], [*late, (9, 901, far)])):
            spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / f"{name}/{i}"))
    read = lambda name, kind, c: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*")).withWatermark(c, "20 seconds")
    joined = interval_join(read("l", "k int, i long, t timestamp", "t"), read("r", "k int, j long, u timestamp", "u"), "k", "t", "u", 10, 20, outer=True)
    store = Store(spark, str(tmp_path / "store"))
    sink = committed(joined, store, "pairs", "join").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append")
    real, calls = store.commit, []

    def lost(*a, **b):
        """The first commit is made, but the driver dies before the query has heard of it."""
        out = real(*a, **b)
        calls.append(b["writer"])
        if len(calls) == 2:
            raise OSError("lost")
        return out

    store.commit = lost
    q = sink.start()
    with pytest.raises(Exception, match="lost"):
        q.processAllAvailable()
    q = sink.start()
    q.processAllAvailable()
    q.stop()
    assert len(set(calls)) == len(calls)  # the lost batch was run again, but not committed again
    got = sorted((tuple(r) for r in store.read("pairs").collect() if r["k"] != 9), key=str)
    assert got == plain_join(left, right, 10, 20, True)


def test_documents_and_chunks_come_together_and_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id long, checksum string")
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "doc_id long, ordinal int")
    memory.ingest(store, docs, chunks)
    memory.ingest(store, docs, chunks)
    memory.ingest(store, docs.withColumn("doc_id", F.col("doc_id") + 10).withColumn("checksum", F.concat("checksum", F.lit("z"))), chunks.withColumn("doc_id", F.col("doc_id") + 10))
    assert sorted(r["doc_id"] for r in store.read("documents").collect()) == [1, 2, 11, 12]
    assert sorted(tuple(r) for r in store.read("chunks").collect()) == [(1, 0), (1, 1), (2, 0), (11, 0), (11, 1), (12, 0)]


def test_memory_changes_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rng = random.Random(5)
    kind = "id long, layer string, subject string, predicate string, value string, confidence double, created timestamp, tags array<string>"
    rows = [(i, rng.choice("ab"), rng.choice("xyz"), "p", rng.choice("uv"), round(rng.random(), 1), at(i), [rng.choice("st"), "all"]) for i in range(90)]
    for n in range(3):
        memory.remember(store, spark.createDataFrame(rows[30 * n : 30 * n + 30], kind), cap=1000, writer=("memory", n))
        memory.remember(store, spark.createDataFrame(rows[30 * n : 30 * n + 30], kind), cap=1000, writer=("memory", n))  # a second try changes nothing
    every = spark.createDataFrame(rows, kind)
    live = {r["id"] for r in supersede(every, list(memory.KEY), "created", "value", "confidence", "id").filter("live").collect()}
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(store.read("memory")) == sorted(live) and ids(store.read("archive")) == sorted(set(range(90)) - live) and store.manifest().version == 3
    tag = spark.createDataFrame([("s",), ("s",)], "tag string")
    assert ids(memory.tagged(store, tag)) == sorted(i for i in live if "s" in rows[i][7])
    memory.forget(store, spark.createDataFrame([(min(live),), (12345,)], "id long"))
    assert ids(store.read("memory")) == sorted(live - {min(live)}) and min(live) not in {r["id"] for r in store.read("tags").collect()}
    memory.remember(store, spark.createDataFrame([(200, "a", "x", "p", "new", 1.0, at(200), None)], kind), cap=2)
    capped = store.read("memory").groupBy("layer").count().collect()
    assert all(r["count"] <= 2 for r in capped) and 200 in ids(store.read("memory"))
    assert {r["reason"] for r in store.read("archive").collect()} == {"superseded", "over the cap"}
    assert store.commit({"memory": Change(None, whole=True)}) and memory.tagged(store, tag).count() == 0
