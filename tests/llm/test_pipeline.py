import itertools
import unicodedata

from pyspark.sql import functions as F

import corpus_pipeline as P
from weftlight.llm import language
from weftlight.llm.simhash import shingle_set

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    a, b = shingle_set(a, 5), shingle_set(b, 5)
    return len(a & b) / len(a | b) if a or b else 1.0


def near_groups(rows):
    up = {d: d for d in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        if jaccard(rows[a], rows[b]) >= 0.8:
            up[find(a)] = find(b)
    return {d: find(d) for d in rows}


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    parts = docs.filter("length(text) > 1000").groupBy("lang").agg(F.expr("substr(min(text), 1, 600)").alias("t")).collect()
    assert len(parts) == 4
    extra = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "12 34 ..", "en", "s", 8), (90003, "", None, "s", 0), (90004, " ".join(r["t"] for r in parts), None, "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    one = P.language_id(spark, docs, SF)
    assert one.columns == cols
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = language.fit(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    score = {r["doc_id"]: r["score"] for r in language.predict(docs, model).collect()}
    kept = {d for d, t in rows.items() if any(unicodedata.category(c)[0] == "L" for c in t or "") and (score[d] >= language.LEAST_SHARE or len(language.tokens(t)) < language.LEAST_WORDS)}
    assert 90004 not in kept and {r["doc_id"] for r in one.collect()} == kept
    two = P.exact_dedup_stage(spark, one, SF)
    best = {}
    for d in sorted(kept):
        best[rows[d]] = d
    assert two.columns == cols and {r["doc_id"] for r in two.collect()} == set(best.values())
    three = P.near_dedup(spark, two, SF)
    left = {r["doc_id"] for r in three.collect()}
    group = near_groups({d: rows[d] for d in best.values()})
    assert three.columns == cols and left <= set(group)
    want = {}
    for d, g in group.items():
        want[g] = min(want.get(g, d), d)
    assert left == set(want.values())
    four = P.pack(spark, three, SF)
    assert {r["doc_id"] for r in four.select("doc_id").collect()} == left


def test_run_and_planted_copies(spark):
    text = " ".join(f"word{i}" for i in range(300))
    near = text.replace("word150", "changed")
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, near, "en", "s", 1), (4, " ".join(f"other{i}" for i in range(300)), "en", "s", 1), (5, None, None, None, None), (None, "a null id", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    two = P.exact_dedup_stage(spark, df, SF)
    assert sorted(str(r["doc_id"]) for r in P.near_dedup(spark, two, SF).collect()) == ["2", "4", "5", "None"]
    assert P.near_dedup(spark, df.limit(0), SF).count() == 0
    assert P.run(spark, SF).count() > 100


KINDS = "doc_id long, text string, lang string, score double, lang_pred string, uid long, k long, check int, c0 string, `a b` int"


def test_clashing_names_repeated_ids_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(100))
    more = ("en", 1.0, "x", 1, 2, 3, "c", 4)
    rows = [(1, text, *more), (2, text + " end", *more), (2, "an unrelated text of id two", *more), (2, "an unrelated text of id two", *more), (3, "½ ² ① Ⅷ 12", *more), (4, None, *more), (5, "", *more), (6, "été", *more)]
    docs = spark.createDataFrame(rows, KINDS)
    one = P.language_id(spark, docs, SF)
    assert one.schema == docs.schema and sorted(r["doc_id"] for r in one.collect()) == [1, 2, 2, 2, 6]
    two = P.exact_dedup_stage(spark, docs, SF)
    assert two.schema == docs.schema and sorted(r["doc_id"] for r in two.collect()) == [1, 2, 2, 3, 5, 6]
    three = P.near_dedup(spark, docs, SF)
    assert three.schema == docs.schema
    assert sorted((r["doc_id"], r["text"]) for r in three.collect() if r["text"]) == sorted([(1, text), (2, "an unrelated text of id two"), (3, "½ ² ① Ⅷ 12"), (6, "été")])
    assert sorted(r["doc_id"] for r in three.collect() if not r["text"]) == [4]
    assert P.pack(spark, docs, SF).count() == len(rows)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")  # nothing to learn from
    assert sorted(r["doc_id"] for r in P.language_id(spark, bare, SF).collect()) == [1, 2, 2, 2, 6]
