import numpy as np
from pyspark.sql import functions as F

from weftlight.llm import language as L

SF = "/root/testdata/sf0.01"


def slow_marginals(scores, first, trans):
    out, edges = np.zeros_like(scores), [*np.flatnonzero(first).tolist(), len(scores)]
    t = np.exp(trans)
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        f, b = [np.exp(scores[a])], [np.ones(scores.shape[1])]
        for i in range(a + 1, z):
            f.append(f[-1] @ t * np.exp(scores[i]))
        for i in range(z - 1, a, -1):
            b.append(t @ (b[-1] * np.exp(scores[i])))
        for i in range(z - a):
            out[a + i] = f[i] * b[z - a - 1 - i]
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_equal_the_plain_recursion():
    rng = np.random.default_rng(1)
    for n in (1, 5, 400):
        scores, trans = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        first = rng.random(n) < 0.1
        first[0] = True
        for width in (1, 4, 2048):
            assert np.allclose(L.forward_backward(scores, first, trans, width), slow_marginals(scores, first, trans))


def test_held_out_accuracy_and_edge_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in L.identify(docs).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [d for d in got if got[d]["held_out"]]
    assert len(got) == len(lang) and 100 < len(held) < 300
    assert sum(got[d]["lang_pred"] == lang[d] for d in held) / len(held) > 0.95
    odd = spark.createDataFrame([(1, None, "en", 1.0), (2, "123 ...", "en", 1.0), (3, "", None, 1.0)], "doc_id long, text string, lang string, score double")
    rows = L.identify(odd).collect()
    assert {r["lang_pred"] for r in rows} == {"und"} and {r["score"] for r in rows} == {0.0}
    assert L.identify(docs.limit(0)).count() == 0


def test_switches_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs)
    text = {r["lang"]: " ".join(L.tokens(r["text"])[:60]) for r in docs.filter("length(text) > 3000").select("lang", "text").collect()}
    df = spark.createDataFrame([(1, text["en"] + " " + text["fr"])], "doc_id long, text string")
    row = L.predict(df, model, spans=True).collect()[0]
    assert [s["lang"] for s in row["switches"]][0] == "en" and "fr" in [s["lang"] for s in row["switches"]]


def test_numerals_are_no_letters(spark):
    rows = [(1, "½ ² ① Ⅷ 三".replace(" 三", "")), (2, "² été"), (3, "中文"), (3, "中文"), (None, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang")
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in L.identify(docs.unionByName(spark.createDataFrame([(i, "a learned text", "en") for i in range(10, 30)], docs.schema))).collect() if (r["doc_id"] or 0) < 10)
    assert got == [("1", "und"), ("2", "en"), ("3", "en"), ("3", "en"), ("None", "en")]


def test_the_training_sample_is_the_first_rows_by_hash(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('text ', id, if(id % 10 = 0, repeat(' long', 2000), '')) as text", "if(id < 20, 'a', 'b') as lang")
    got = L.training_texts(docs, 30)
    assert sum(x == "a" for x, _ in got) == 20 and sum(x == "b" for x, _ in got) == 30 and not any(len(t) > 8000 for x, t in got if x == "b")
    first = docs.filter("lang = 'b' and id % 10 <> 0".replace("id", "doc_id")).orderBy(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))).limit(30).collect()
    assert {t for x, t in got if x == "b"} == {r["text"] for r in first}


def test_repeated_ids_send_one_text_a_hash_to_the_driver(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("cast(if(id < 1000, null, if(id < 2000, 7, id)) as long) as doc_id", "concat('text ', lpad(id, 5, '0')) as text", "'en' as lang")
    sent, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: sent.append(collect(self)) or sent[-1])
    got = L.training_texts(docs, 900)
    texts = [r for rows in sent for r in rows if "text" in r]
    assert len(got) == 900 == len(texts) == len({r["h"] for r in texts})
    every = L.training_texts(docs, 2000)
    assert len(every) == 1002 and ("en", "text 00999") in every and ("en", "text 01999") in every


def test_texts_in_no_language_of_the_model_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs)
    text = {r["lang"]: " ".join(L.tokens(r["text"])[:80]) for r in docs.filter("length(text) > 3000").select("lang", "text").collect()}
    every = " ".join(text.values())
    rows = [(1, every), (3, text["en"] + " " + text["fr"]), (4, text["de"]), (5, "Avec."), (6, "Слово"), (7, "12 ."), (1, every)]
    odd = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, score double, lang_pred string")
    kept = L.recognised(odd, model)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert L.recognised(docs, model).count() >= 0.998 * docs.count()
