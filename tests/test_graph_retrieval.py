"""Graph retrieval against plain walks."""

import random
import re
from datetime import datetime

import pytest

from weftlight.operators import graph_retrieval as G


def test_derived_edges(spark):
    entities = spark.createDataFrame([("e1", 0.9, ["c1", "c2"]), ("e2", 0.5, None)], "id string, confidence double, chunks array<string>")
    claims = spark.createDataFrame([("k1", 0.8, ["c1"], ["c3"], "e1", "e2"), ("k2", 0.7, None, None, None, "e1")], "id string, confidence double, chunks array<string>, against array<string>, subject string, object string")
    events = spark.createDataFrame([("v1", 0.6, ["c2"], ["e1", "e2"], "e2")], "id string, confidence double, chunks array<string>, participants array<string>, location string")
    more = spark.createDataFrame([("e1", "entity", "e2", "entity", "RELATES_TO", 0.1, "c9"), ("e1", "entity", "e2", "entity", "RELATES_TO", 0.4, "c9")], "src string, src_type string, dst string, dst_type string, kind string, confidence double, chunk string")
    got = {(r["src"], r["dst"], r["kind"], r["chunk"], r["confidence"]) for r in G.derived_edges(entities, claims, events, more).collect()}
    assert got == {
        ("c1", "e1", "MENTIONS", "c1", 0.9), ("c2", "e1", "MENTIONS", "c2", 0.9), ("c1", "k1", "DERIVED_FROM", "c1", 0.8), ("c1", "k1", "SUPPORTS", "c1", 0.8), ("c3", "k1", "CONTRADICTS", "c3", 0.8),
        ("k1", "e1", "RELATES_TO", "c1", 0.8), ("k1", "e2", "RELATES_TO", "c1", 0.8), ("k2", "e1", "RELATES_TO", None, 0.7), ("c2", "v1", "DERIVED_FROM", "c2", 0.6),
        ("e1", "v1", "RELATES_TO", "c2", 0.6), ("e2", "v1", "RELATES_TO", "c2", 0.6), ("e1", "e2", "RELATES_TO", "c9", 0.4),
    }


def test_seed_names_in_the_order_they_are_seen(spark):
    texts = [(1, 1, "The Acme Corp met Bob. At noon Xy and Acme Corp left."), (1, 2, "then Widget, WIDGET and Élan; Ab"), (1, 6, "Never"), (2, 1, "nothing here"), (3, 1, " ".join(f"Name{c}x, Na{c}" for c in "abcdefghijklmnop"))]
    more = spark.createDataFrame([(1, 1, "bob"), (1, 2, "Zed"), (2, 1, "Only")], "q long, turn int, name string")
    hits = spark.createDataFrame(texts, "q long, rank int, t string")
    got = {}
    for r in G.seed_names(hits, "q", "t", more).orderBy("q", "turn").collect():
        got.setdefault(r["q"], []).append(r["name"])
    want = {}
    for q in (1, 2, 3):
        names = []
        for _, rank, t in [x for x in texts if x[0] == q]:
            if rank <= 5:
                names += [m for m in re.findall(G.PHRASE, t) if len(m) > 2 and m not in names]
        out = []
        for n in names[:10] + {1: ["bob", "Zed"], 2: ["Only"]}.get(q, []):
            if n.lower() not in [x.lower() for x in out]:
                out.append(n)
        want[q] = out[:5]
    assert got == want and got[1][0] == "The Acme Corp" and len(got[3]) == 5


def walk(edges, own, seeds, hops, kinds, start, end):
    visited, scores, every, front = set(), {}, set(), set(seeds)
    for hop in range(hops):
        new = set()
        for n in front - visited:
            visited.add(n)
            every |= own.get(n, set())
            for s, d, kind, conf, chunk, a, z in edges:
                if s != n or kind not in kinds:
                    continue
                every.add(chunk)
                if start and a and a < start or end and z and z > end:
                    continue
                scores[chunk] = max(scores.get(chunk, 0), conf * 0.8**hop)
                new.add(d)
        front = new
    return {c: scores.get(c, 0.5) for c in every if c is not None}


@pytest.mark.parametrize(("hops", "window"), [(1, False), (2, True), (4, False)])
def test_walk_equals_the_plain_one(spark, hops, window):
    rng = random.Random(hops)
    day = lambda: rng.choice([None, datetime(2024, rng.randrange(1, 12), 1)])
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.choice([*G.KINDS, "OTHER"]), rng.choice([0.2, 0.5, 0.9]), rng.choice([None, *(f"c{i}" for i in range(30))]), day(), day()) for _ in range(70)]
    own = {f"n{i}": {f"d{i % 7}"} for i in range(0, 25, 2)}
    seeds = {q: {f"n{rng.randrange(25)}" for _ in range(2)} for q in range(6)}
    e = spark.createDataFrame(edges, "src string, dst string, kind string, confidence double, chunk string, valid_from timestamp, valid_to timestamp")
    n = spark.createDataFrame([(k, c) for k, cs in own.items() for c in cs], "node string, chunk string")
    s = spark.createDataFrame([(q, x) for q, xs in seeds.items() for x in xs], "q int, node string")
    start, end = ("2024-04-01", "2024-09-01") if window else (None, None)
    got = {}
    for r in G.evidence(e, n, s, "q", hops, start=start, end=end).collect():
        got.setdefault(r["q"], {})[r["chunk"]] = round(r["score"], 9)
    parse = lambda x: x and datetime.fromisoformat(x)
    want = {q: {c: round(v, 9) for c, v in walk(edges, own, xs, hops, G.KINDS, parse(start), parse(end)).items()} for q, xs in seeds.items()}
    assert got == {q: w for q, w in want.items() if w}


def test_search_keeps_first_results_and_fills_up(spark):
    hits = spark.createDataFrame([(1, "a", "We met Acme Corp.", 2.0, 1), (1, "b", "no name", 1.0, 2), (2, "b", "none", 1.0, 1)], "q long, chunk string, text string, score double, rank int")
    names = spark.createDataFrame([("acme corp", "n1"), ("We", "n9")], "name string, node string")
    edges = spark.createDataFrame([("n1", "n2", "RELATES_TO", 0.9, "b"), ("n1", "n2", "SUPPORTS", 0.5, "x"), ("n2", "n3", "RELATES_TO", 1.0, "y"), ("n1", "n3", "OTHER", 1.0, "z")], "src string, dst string, kind string, confidence double, chunk string")
    own = spark.createDataFrame([("n2", "w")], "node string, chunk string")
    rows = lambda k: [(r["q"], r["chunk"], round(r["score"], 6), r["rank"]) for r in G.search(hits, names, edges, own, "q", k).orderBy("q", "rank").collect()]
    assert rows(9) == [(1, "a", 2.0, 1), (1, "b", 1.0, 2), (1, "y", 0.8, 3), (1, "w", 0.5, 4), (1, "x", 0.5, 5), (2, "b", 1.0, 1)]
    assert rows(3) == [(1, "a", 2.0, 1), (1, "b", 1.0, 2), (1, "y", 0.8, 3), (2, "b", 1.0, 1)]
