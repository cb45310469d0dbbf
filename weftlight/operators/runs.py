"""Runs of many variants over many items that can be stopped and taken up again: a ledger of what is done."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlight.sources.snapshots import Manifest, Store

LEDGER = "runs"


def pending(store: Store, at: Manifest, items: DataFrame, key: str, variants: list[str], retry_failed: bool) -> DataFrame:
    """items with a column variant: the pairs that the ledger has no outcome of (retry_failed: no successful one)."""
    todo = items.withColumn("variant", F.explode(F.lit(sorted(variants))))
    if LEDGER not in at.tables:
        return todo
    done = store.read(LEDGER, of=at)
    done = done.filter("ok") if retry_failed else done
    return todo.join(done.select(key, "variant").distinct(), [key, "variant"], "left_anti").select(*todo.columns)


def run(store: Store, items: DataFrame, key: str, variants: dict[str, Callable[[dict], dict]], rounds: int = 8, retry_failed: bool = False) -> int:
    """Apply each variant to each item that is still to be done; how many rounds had something to do.

    A variant gets an item as a dict and returns a dict; what it raises is the outcome of that pair alone. Pairs are dealt
    out to rounds by a hash, and a round's outcomes (key, variant, ok, result as JSON, error, attempt) are one commit, made
    anew if another runner commits meanwhile. A run that is killed loses the round it is in; started again, it runs the pairs
    that have no outcome, also those of new items or variants.
    """
    kind = items.schema[key].dataType.simpleString()
    columns = items.columns

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                try:
                    rows.append((r[key], r["variant"], True, json.dumps(variants[r["variant"]]({c: r[c] for c in columns}), default=str), None))
                except Exception as e:  # noqa: BLE001  a variant may raise anything; it becomes the pair's outcome
                    rows.append((r[key], r["variant"], False, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=[key, "variant", "ok", "result", "error"])

    busy = 0
    for i in range(rounds):

        def make(at: Manifest, i: int = i) -> dict[str, DataFrame]:
            part = pending(store, at, items, key, list(variants), retry_failed).filter(F.pmod(F.xxhash64(key, "variant"), F.lit(rounds)) == i)
            return {LEDGER: part.mapInPandas(work, f"`{key}` {kind}, variant string, ok boolean, result string, error string").withColumn("attempt", F.lit(at.version + 1).cast("long"))}

        left = pending(store, store.manifest(), items, key, list(variants), retry_failed)
        if not left.filter(F.pmod(F.xxhash64(key, "variant"), F.lit(rounds)) == i).isEmpty():
            store.update((LEDGER,), make, whole=False)
            busy += 1
    return busy


def outcomes(store: Store, key: str, version: int | None = None) -> DataFrame:
    """(key, variant, ok, result, error, attempt): the last outcome of every pair."""
    w = Window.partitionBy(key, "variant").orderBy(F.desc("attempt"))
    return store.read(LEDGER, version).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def progress(store: Store, items: DataFrame, key: str, variants: list[str]) -> DataFrame:
    """(variant, done, failed, left) of each variant over the items."""
    last = outcomes(store, key) if LEDGER in store.manifest().tables else None
    todo = items.select(key).withColumn("variant", F.explode(F.lit(sorted(variants))))
    state = todo.withColumn("ok", F.lit(None).cast("boolean")) if last is None else todo.join(last.select(key, "variant", "ok"), [key, "variant"], "left")
    return state.groupBy("variant").agg(F.count_if(F.col("ok")).alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("left"))
