"""Joins and groups stay bounded and give what looking at every pair, or at every row in turn, gives."""

import random
import re

from pyspark.sql import functions as F

from weftlight.operators import extraction, lexical, planning, selection


def _linked(texts, names):
    low = lambda x: " " + re.sub(r"\W+", " ", x.lower()) + " "
    return {(k, i) for k, x in texts if x for i, n in names if n and re.search(r"\w", n) and low(n) in low(x)}


def test_linked_entities_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(k, rng.choice([None, ""]) if k % 10 == 0 else " ".join(rng.choice(["Core", "engine,", "old", "Mill.", "a-b", "x"]) for _ in range(rng.randrange(9)))) for k in range(60)]
    names = [(f"e{i}", n) for i, n in enumerate(["core", "Core Engine", "old mill core", "a b", "x", "X", "none", None, "", "!", "mill x", "-core"])]
    t, n = spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(names, "id string, name string")
    want = _linked(texts, [(i, x) for i, x in names if x != "-core"])
    for most in (1 << 18, 0):
        monkeypatch.setattr(extraction, "MOST_NAMES", most)
        got = sorted(tuple(r) for r in extraction.linked_entities(t, n, "k").collect())
        assert len(got) == len(set(got)) and {g for g in got if g[1] != "e11"} == want


def test_no_text_is_copied_for_its_words(spark):
    """Every word of a text took the whole text along to the join."""
    words = " ".join(f"w{i:03d}" for i in range(400))
    t = spark.range(500).select(F.col("id").alias("k"), F.concat(F.lit(words), F.col("id").cast("string")).alias("text"))
    names = spark.createDataFrame([(1, "w007"), (2, "w010 w011")], "id int, name string")
    hits = extraction.linked_entities(t, names, "k")
    assert hits.groupBy("id").count().collect() and hits.count() == 1000
    for line in hits._jdf.queryExecution().executedPlan().toString().splitlines():
        if "Generate explode" in line:
            assert "[k#" in line and ", t#" not in line


def test_seeded_equals_all_pairs_and_keeps_ties_by_item(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    some = lambda: rng.sample(words, rng.randrange(7))
    questions = [(i, i % 3, some()) for i in range(40)] + [(90, 0, words), (91, 0, ["none"]), (92, 0, None)]
    hyps = [(i, some()) for i in rng.sample(range(1000), 80)] + [(1000 + i, ["w1", "w2"]) for i in range(30)] + [(2000, None), (2001, [f"x{i}" for i in range(127)] + ["w0"])]
    want = set()
    for a, b, q in questions:
        got = [(-int(len({*q} & {*h}) / len({*q} | {*h}) * 1e6 + 0.5), i) for i, h in hyps if q and h and {*q} & {*h}]
        want |= {(a, b, i, -v / 1e6, r) for r, (v, i) in enumerate(sorted(got)[:3], 1)}
    q = spark.createDataFrame(questions, "a long, b int, q array<string>").repartition(3)
    h = spark.createDataFrame(hyps, "item long, h array<string>").repartition(5)
    for terms in (1 << 22, 40):
        monkeypatch.setattr(planning, "SEED_TERMS", terms)
        assert {tuple(r) for r in planning.seeded(q, ["a", "b"], h, "item", 3).collect()} == want
    assert planning.seeded(q.limit(0), ["a", "b"], h, "item", 3).count() == 0 == planning.seeded(q, ["a", "b"], h.limit(0), "item", 3).count()


def test_seeded_makes_no_row_of_a_pair(spark):
    """All of 300 questions and 400 hypotheses share a word: 120 000 rows of pairs before, 3 rows a question and task now."""
    side = lambda n, c: spark.range(n).select(F.col("id").alias("item" if c == "h" else "k"), F.array(F.lit("the"), F.col("id").cast("string")).alias(c))
    out = planning.seeded(side(300, "q"), ["k"], side(400, "h"), "item", 3)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 900


def _items(spark, n=600):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)]
    rows = [(f"é{i}" if i % 7 else None if i == 7 else f"z{i}", i % 4, "rare w1 w2" if i % 3 == 0 else " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(n)]
    rng.shuffle(rows)
    items = spark.createDataFrame([*rows, ("none", 0, None), ("empty", 0, "")], "a string, b int, text string").repartition(3)
    asks = [(1, "w1 W1 w3 other"), (2, "rare"), (3, "w1 w2 rare"), (4, "never"), (5, None), (6, "w24"), (7, "")]
    return items, spark.createDataFrame(asks, "q int, text string")


def test_best_in_tasks_keeps_ties_by_keys(spark):
    items, asks = _items(spark)
    rows = lambda df: {tuple(r) for r in df.select("q", "a", "b", "score", "rank").collect()}
    want = rows(lexical.top_k(lexical.bm25_scores(items, ["a", "b"], asks, "q"), ["q"], 9, ["a", "b"]))
    assert rows(lexical.bm25_top_k(items, ["a", "b"], asks, "q", 9)) == want and len(want) > 20
    assert rows(lexical.sparse_top_k(items, ["a", "b"], asks, "q", 9)) == rows(lexical.top_k(lexical.sparse_dot(items, ["a", "b"], asks, "q"), ["q"], 9, ["a", "b"]))


def test_a_task_keeps_k_rows_a_question(spark, monkeypatch):
    """Items that score alike, or nothing, were all kept before: tasks now give k rows a question at most."""
    items, asks = _items(spark)
    seen = []
    plain = lexical.top_k
    monkeypatch.setattr(lexical, "top_k", lambda scores, *a, **kw: seen.append(scores.groupBy("q", F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]) or plain(scores, *a, **kw))
    lexical.bm25_top_k(items, ["a", "b"], asks, "q", 9)
    lexical.sparse_top_k(items, ["a", "b"], asks, "q", 9)
    assert seen == [9, 9]


def _superseded(rows):
    """Rows (id, key, at, value, confidence) one after the other: the ids that are live."""
    live, standing, out = {}, {}, set()
    for i, k, _, v, c in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        if k not in standing:
            standing[k], live[k] = (v, c), {i}
            continue
        old, sure = standing[k]
        takes = c is not None and sure is not None and c >= sure
        if v != old and takes:
            live[k] = set()
        if v == old or takes:
            live[k].add(i)
        if takes:
            standing[k] = (v, c)
    for ids in live.values():
        out |= ids
    return out


def test_supersession_row_by_row(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None, *"cdefgh"]), rng.choice([None, *range(30)]), rng.choice(["u", "v", None]), rng.choice([None, 0.1, 0.5, 0.5, 0.9]) if i % 3 else rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, at long, v string, c double").repartition(3)
    out = selection.supersede(df, ["k"], "at", "v", "c", "id")
    assert out.columns == [*df.columns, "live"] and {r["id"] for r in out.filter("live").collect()} == _superseded(rows) and out.count() == 400
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()  # a key's rows are not held by one call


def test_a_large_cap_sorts_no_layer_in_one_task(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, 1.0, 2.0])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, layer string, c double")
    order = [F.desc("c"), F.col("id")]
    for cap in (7, 60, 500):
        want = sorted(r["id"] for r in selection.layer_cap(df, "layer", cap, order).collect())
        with monkeypatch.context() as m:
            m.setattr(selection, "MOST_RANKED", 3)
            out = selection.layer_cap(df, "layer", cap, order)
            assert sorted(r["id"] for r in out.collect()) == want and out.columns == df.columns
            assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_levels_search_once(spark, monkeypatch):
    from weftlight.plans import catalogue, evidence_queries

    calls, plain = [], evidence_queries.lexical_hits
    monkeypatch.setattr(evidence_queries, "lexical_hits", lambda t: calls.append(1) or plain(t))
    assert catalogue.QUERIES["sufficiency_level"](spark, "/root/testdata/sf0.001").count() > 0 and calls == [1]


def test_sales_are_ranked_once_a_query(spark):
    """Each use of the reports ranked all sales again: 33 scans of lineitem in one plan of recovered_evidence."""
    from weftlight.plans import catalogue, frames, registry

    t = registry.Tables(spark, "/root/testdata/sf0.001")
    assert frames.reports(t) is frames.reports(t) and frames.reports(t).count() == 6 * frames.questions(t).count()
    plan = catalogue.QUERIES["recovered_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "part.parquet" not in plan


def test_words_are_looked_up_in_bounded_pieces(spark, monkeypatch):
    """All words of an Arrow batch were looked up at once, however many they were."""
    items, asks = _items(spark)
    rows = lambda df: {tuple(r) for r in df.select("q", "a", "b", "score", "rank").collect()}
    want = rows(lexical.bm25_top_k(items, ["a", "b"], asks, "q", 9))

    class Bounded:
        def __getattr__(self, name):
            import pyarrow.compute as pc

            def index_in(values, **kw):
                if len(values) > 41:  # WORDS and the longest item
                    raise ValueError(f"{len(values)} words at once")
                return pc.index_in(values, **kw)

            return index_in if name == "index_in" else getattr(pc, name)

    monkeypatch.setattr(lexical, "WORDS", 30, raising=False)
    monkeypatch.setattr(lexical, "pc", Bounded())
    assert rows(lexical.bm25_top_k(items, ["a", "b"], asks, "q", 9)) == want
