"""Alias closure across batches against union-find over everything at once."""

import random

import pytest

from weftlight.operators.resolution import groups, looked_up, resolve

KIND = "id long, name string, aliases array<string>"


def fold(x):
    return " ".join((x or "").lower().split()) or None


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def test_chains_over_three_batches_are_one_entity_and_cycles_end(spark):
    rows = [[(10, "Acme Corp", ["ACME"]), (11, "Widget", None)], [(20, "Umbrella", ["umb"]), (21, "acme  corp", [])], [(30, "umb", ["acme"]), (31, "A", ["B"]), (32, "B", ["C"]), (33, "c", ["a"]), (34, None, ["  ", "x1"]), (35, " ", None)]]
    index, all_moved = None, []
    for batch in rows:
        index, moved = resolve(index, spark.createDataFrame(batch, KIND))
        all_moved += [tuple(r) for r in moved.collect()]
    got = {r["name"]: r["id"] for r in index.collect()}
    assert got == {"acme corp": 10, "acme": 10, "widget": 11, "umbrella": 10, "umb": 10, "a": 31, "b": 31, "c": 31, "x1": 34}
    assert all_moved == [(20, 10)]
    asked = spark.createDataFrame([("ACME  Corp",), ("nobody",), (None,)], "name string")
    assert sorted((str(r["name"]), r["id"]) for r in looked_up(index, asked).collect()) == [("ACME  Corp", 10), ("None", None), ("nobody", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_one_union(spark, seed):
    rng = random.Random(seed)
    name = lambda: f"N{rng.randrange(70)}"
    rows = [(i, rng.choice([name(), name(), None]), [name() for _ in range(rng.randrange(3))]) for i in range(60)]
    index = None
    for i in range(0, 60, 20):
        index, _ = resolve(index, spark.createDataFrame(rows[i : i + 20], KIND))
    union, owner = Union(), {}
    for i, n, aliases in rows:
        for a in [n, *aliases]:
            if fold(a):
                union.join(("id", i), fold(a))
    for i, n, aliases in rows:
        if any(fold(a) for a in [n, *aliases]):
            owner.setdefault(union.find(("id", i)), i)
    got = {r["name"]: r["id"] for r in index.collect()}
    names = {fold(a) for _, n, aliases in rows for a in [n, *aliases] if fold(a)}
    assert set(got) == names
    # the same names are together; the id is the oldest of the index at the time, so of the first batch that any name was in
    assert {frozenset(n for n in names if got[n] == i) for i in got.values()} == {frozenset(n for n in names if union.find(n) == r) for r in {union.find(n) for n in names}}
    assert all(got[n] // 20 == owner[union.find(n)] // 20 for n in names)


def test_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(400)] + [(1000, j) for j in range(1001, 1400)] + [(5000, 5000), (None, 7)]
    got = {r["node"]: r["root"] for r in groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(401)} | {j: 1000 for j in range(1000, 1400)} | {5000: 5000}
    assert groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_sql(spark):
    from tests.oracle import compare
    from weftlight.plans import catalogue

    name = "entity_resolution"
    assert compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], "/root/testdata/sf0.001") == ""
