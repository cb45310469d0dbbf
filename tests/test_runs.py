"""Resumable runs: what has an outcome isn't run again, and one item's fault is its own."""

import json

import pytest

from weftlight.operators import runs
from weftlight.sources.snapshots import Store


def variants(log, broken=(3,)):
    def one(item):
        with open(log, "a") as f:
            f.write(f"one {item['id']}\n")
        if item["id"] in broken:
            raise ValueError(f"item {item['id']}")
        return {"size": len(item["text"]), "at": item["id"]}

    def two(item):
        with open(log, "a") as f:
            f.write(f"two {item['id']}\n")
        return {"text": item["text"]}

    return {"one": one, "two": two}


def test_a_killed_run_goes_on_with_the_rest_only(spark, tmp_path, monkeypatch):
    store, log = Store(spark, str(tmp_path / "s")), str(tmp_path / "log")
    items = spark.createDataFrame([(i, "x" * i) for i in range(12)], "id long, text string")
    commit, made = Store.commit, []

    def killed(self, *a, **b):
        if len(made) == 2:
            raise KeyboardInterrupt
        made.append(commit(self, *a, **b))
        return made[-1]

    monkeypatch.setattr(Store, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        runs.run(store, items, "id", variants(log), rounds=4)
    monkeypatch.undo()
    before = {(r["id"], r["variant"]) for r in runs.outcomes(store, "id").collect()}
    assert 0 < len(before) < 24
    open(log, "w").close()
    runs.run(store, items, "id", variants(log), rounds=4)
    ran = {(int(x.split()[1]), x.split()[0]) for x in open(log)}
    assert ran == {(i, v) for i in range(12) for v in ("one", "two")} - before
    got = {(r["id"], r["variant"]): r for r in runs.outcomes(store, "id").collect()}
    assert len(got) == 24 and store.read("runs").count() == 24
    assert [k for k, r in got.items() if not r["ok"]] == [(3, "one")] and got[3, "one"]["error"] == "ValueError: item 3"
    assert json.loads(got[5, "one"]["result"]) == {"size": 5, "at": 5}
    open(log, "w").close()
    assert runs.run(store, items, "id", variants(log), rounds=4) == 0 and open(log).read() == ""


def test_new_items_and_failed_ones_are_taken_up(spark, tmp_path):
    store, log = Store(spark, str(tmp_path / "s")), str(tmp_path / "log")
    few = spark.createDataFrame([(i, "x") for i in range(4)], "id long, text string")
    assert {tuple(r) for r in runs.progress(store, few, "id", ["one", "two"]).collect()} == {("one", 0, 0, 4), ("two", 0, 0, 4)}
    runs.run(store, few, "id", variants(log), rounds=1)
    assert {tuple(r) for r in runs.progress(store, few, "id", ["one", "two"]).collect()} == {("one", 3, 1, 0), ("two", 4, 0, 0)}
    more = few.unionByName(spark.createDataFrame([(9, "yy")], few.schema))
    open(log, "w").close()
    assert runs.run(store, more, "id", variants(log, broken=()), rounds=1, retry_failed=True) == 1
    assert sorted(open(log).read().split("\n")) == ["", "one 3", "one 9", "two 9"]
    assert all(r["ok"] for r in runs.outcomes(store, "id").collect()) and store.read("runs").count() == 11
    assert runs.run(store, few.limit(0), "id", variants(log)) == 0
