"""Hand-computed cases for rules that tables do not exercise."""

import pytest
from pyspark.sql import functions as F

from weftlight.functions import text as X
from weftlight.operators import chunking, claims, evaluation, fusion, graph, planning, selection
from weftlight.sources import files, sinks


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).collect()[0]["x"]


def test_windows_keep_the_ordinal_of_blank_ones(spark):
    df = spark.createDataFrame([(1, "a" * 10 + " " * 20 + "b" * 5), (2, ""), (3, None)], "doc_id int, text string")
    got = [(r["ordinal"], r["text"].strip()) for r in chunking.windows(df, 10, 0).collect()]
    assert got == [(0, "a" * 10), (3, "bbbbb")]
    with pytest.raises(ValueError):
        chunking.windows(df, 10, 10)


def test_sections_are_compared_in_tokens_and_cut_in_characters(spark):
    df = spark.createDataFrame([(1, "x" * 40 + "\n\n" + "y" * 100)], "doc_id int, text string")
    got = [r["text"] for r in chunking.sections(chunking.lines(df), 20).orderBy("ordinal").collect()]
    assert got == ["x" * 40, *["y" * 20] * 5]


def test_numbers(spark):
    assert one(spark, X.numbers, "Sales of $1,200.5 million [3] and 45% by 1987.") == ["$1200.5 million", "45%", "1987."]
    value = lambda s: one(spark, X.number_value, s)
    assert value("$3.1b") == 3.1e9 and value("12k") == 12e3 and value("3 million") is None and value("7") == 7.0
    m = spark.createDataFrame([(1987.0, 1995.0), (100.0, 100.5), (10.5, 10.55), (0.0, 0.5), (3.0, 3.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in m.select(X.numbers_match(F.col("a"), F.col("b"))).collect()] == [False, True, True, True, True, False]


def test_citations_and_full_width_markers(spark):
    assert one(spark, X.citation_ids, "a [2] b 【１】 c [2]") == [2, 1, 2]
    assert one(spark, X.sentences, "One. Two! Three?  Four") == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, X.has_negation, "It does not grow") and not one(spark, X.has_negation, "It notes growth")


def test_rank_fusion_gives_missing_items_one_over_n(spark):
    lex = spark.createDataFrame([(1, 10, 3.0), (1, 11, 1.0)], "q int, d int, score double")
    den = spark.createDataFrame([(1, 11, 0.9), (1, 12, 0.5)], "q int, d int, score double")
    c = fusion.channels(lex, den, "q", "d")
    got = {r["d"]: r["fused"] for r in fusion.fuse(c, "rank", "q", "d", 10).collect()}
    assert got == {10: round(0.5 * 1 + 0.5 / 3, 8), 11: round(0.5 * 2 / 3 + 0.5 * 1, 8), 12: round(0.5 / 3 + 0.5 * 2 / 3, 8)}
    assert fusion.weights(0, 0) == (0.5, 0.5)
    got = {r["d"]: r["fused"] for r in fusion.fuse(c, "max", "q", "d", 10).collect()}
    assert got[10] == 0.5 and got[12] == 0.25


def test_near_duplicates_and_missing_vectors(spark):
    df = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.8, [0.85, 0.5267826876]), (1, 3, 0.7, None), (1, 4, 0.6, [0.0, 1.0])], "q int, d int, score double, embedding array<double>")
    assert sorted(r["d"] for r in selection.near_duplicates_removed(df, ["q"], "d", threshold=0.84).collect()) == [1, 3, 4]


def test_supersession(spark):
    df = spark.createDataFrame([("s", 1, 1, "a", 0.5), ("s", 2, 2, "b", 0.4), ("s", 3, 3, "c", 0.9), ("s", 4, 4, "c", 0.1)], "k string, id long, at long, v string, conf double")
    assert {r["id"]: r["live"] for r in selection.supersede(df, ["k"], "at", "v", "conf", "id").collect()} == {1: False, 2: False, 3: True, 4: True}


def test_budget_keeps_the_least_number(spark):
    df = spark.createDataFrame([(1, i, 1.0 - i / 10, 100) for i in range(5)], "q int, d int, score double, tokens long")
    assert selection.token_budget(df, ["q"], "d", "tokens", 250).count() == 2
    assert selection.token_budget(df, ["q"], "d", "tokens", 10, 3).count() == 3


def test_k_hop_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b", "x", 1.0), ("b", "c", "x", 0.5), ("c", "a", "x", 1.0), ("b", "d", "y", 1.0)], "src string, dst string, kind string, confidence double")
    s = spark.createDataFrame([("a",)], "seed string")
    assert {(r["node"], r["hop"], round(r["score"], 3)) for r in graph.k_hop(e, s, 4).collect()} == {("a", 0, 1.0), ("b", 1, 0.8), ("c", 2, 0.32), ("d", 2, 0.64)}
    assert {r["node"] for r in graph.k_hop(e, s, 4, kinds=["x"]).collect()} == {"a", "b", "c"}
    assert {tuple(r["path"]) for r in graph.paths(e, s, 2).collect()} == {("a",), ("a", "b"), ("a", "b", "c"), ("a", "b", "d")}


def test_claims_and_support(spark):
    a = spark.createDataFrame([(1, "Acme grew 5 percent and Beta fell 3 percent [1]. Nothing was cited here at all. Acme is large [9].")], "id int, text string")
    c = evaluation.claims(a, ["id"])
    assert [r["claim"] for r in c.orderBy("claim_no").collect()] == ["Acme grew 5 percent", "Beta fell 3 percent.[1]", "Nothing was cited here at all.", "Acme is large [9]."]
    t = spark.createDataFrame([(1, 1, "Beta fell 3 percent last year")], "id int, position int, text string")
    assert [r["status"] for r in evaluation.support(c, t, ["id"]).orderBy("claim_no").collect()] == ["no_citation", "supported", "no_citation", "invalid_citation"]


def test_typed_conflicts(spark):
    rows = [(1, "s", "p", "X", 10.0, "2020-01-01", "2021-01-01"), (2, "s", "p", "Y", 10.0, "2020-06-01", None), (3, "s", "p", "x", 20.0, "2022-01-01", None)]
    df = spark.createDataFrame(rows, "id int, subject string, predicate string, object string, value double, valid_from string, valid_to string")
    assert {(r["a"], r["b"], r["kind"]) for r in claims.typed_conflicts(df).collect()} == {(1, 2, "object"), (1, 3, "temporal"), (2, 3, "object"), (2, 3, "value")}


@pytest.mark.parametrize(("q", "want"), [("Show the figure of sales", "multimodal"), ("Several things happened", "historical"), ("What is the latest status?", "fresh_missing"), ("An overview of it", "long_report"), ("compare apples with pears", "comparative"), ("how to bake bread", "procedural"), ("define entropy", "exact_term"), ("why does it rain", "conceptual"), ("sources disagree, however", "conflict"), ("it depends on X via Y", "multi_hop")])
def test_patterns(spark, q, want):
    assert one(spark, planning.question_pattern, q) == want


def test_complexity(spark):
    assert one(spark, planning.complexity, "What is entropy?") == "fast"
    assert one(spark, planning.complexity, "Alpha met Beta and later Gamma") == "strong"
    assert one(spark, planning.complexity, "") == "balanced"
    assert one(spark, planning.complexity, "tell me things") == "balanced"


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "b.md").write_text("# T\nx")
    (tmp_path / "A.csv").write_text("k;v\n1;a\n2;\n")
    (tmp_path / "c.bin").write_text("no")
    got = [(r["path"].rsplit("/", 1)[-1], r["kind"]) for r in files.discover(spark, str(tmp_path)).collect()]
    assert got == [("A.csv", "spreadsheet"), ("b.md", "text")]
    sheet = files.delimited(spark, str(tmp_path / "A.csv"))
    assert sheet.columns == ["k", "v"]
    cells = files.cells(sheet, "k")
    assert [tuple(r) for r in cells.collect()] == [("1", "v", "a")]
    assert files.sheet_text(cells, "k", ["v"]).collect()[0]["line"] == "a"
    out = str(tmp_path / "t")
    sinks.write_whole(spark.range(3).toDF("x"), out)
    sinks.write_whole(spark.range(5).toDF("x"), out)
    assert spark.read.parquet(out).count() == 5
    old = spark.createDataFrame([(1, "h1", "p1"), (2, "h2", "p2")], "id long, checksum string, path string")
    new = spark.createDataFrame([(9, "h2", "p9"), (8, "h3", "p3")], "id long, checksum string, path string")
    assert sorted(map(tuple, sinks.upsert(old, new, "checksum", ["id"]).collect())) == [(1, "h1", "p1"), (2, "h2", "p9"), (8, "h3", "p3")]
    post = spark.createDataFrame([("a", 1, 2), ("b", 1, 1)], "term string, doc int, tf int")
    sinks.write_index(post, str(tmp_path / "ix"))
    assert sinks.read_index(spark, str(tmp_path / "ix"), ["a", "z"]).count() == 1
    js, md = sinks.report(spark.createDataFrame([("m", 1.0)], "name string, v double"))
    assert '"name": "m"' in js and md.count("\n") == 2


def test_pages(spark):
    html = "<html lang='en'><head><title>A &amp; B</title></head><body><nav>menu</nav><p>One  <b>two</b></p><script>x()</script><p>&copy;3</p></body></html>"
    assert one(spark, files.page_text, html) == "A & B\nOne\ntwo\n&copy;3"
    url = lambda u: one(spark, files.canonical_url, u)
    assert url("http://a.b/c/?q=1#x") == "https://a.b/c" and url("https://a.b/") == "https://a.b"
    assert not one(spark, files.is_web_url, "http://127.0.0.1/x") and one(spark, files.is_web_url, "https://a.example/x")


def test_notes(spark):
    n = files.parse_note("d/n.md", "---\ntitle: X\ntags: [a, b]\n---\n# One\n#t [[d/e#f|g]]\n## Two\n```\n# no\n```\n# Three\n> [!note] hi\n")
    assert [s["path"] for s in n["sections"]] == ["One", "One > Two", "Three"] and n["tags"] == ["a", "b", "t"] and n["callouts"] == ["note"] and n["code_blocks"] == 1
    assert one(spark, files.link_leaf, "d/e.md#f") == "e"
    df = spark.createDataFrame([("a.md", "# H\n")], "path string, content string")
    assert files.parse_notes(df).collect()[0]["title"] == "H"


def test_extraction(spark):
    from weftlight.operators import extraction as E

    name = lambda s: one(spark, E.entity_name, s)
    assert [name(x) for x in ("Atlas database", "The Acme Corp", "delta sync", "API tool")] == ["Atlas", "Acme", "Delta Sync", "API"]
    df = spark.createDataFrame([(1, "Atlas depends on Beacon. Core Engine replaces Old Mill.")], "doc_id long, text string")
    assert {tuple(r)[1:] for r in E.relations(df).collect()} == {("Atlas", "depends_on", "Beacon"), ("Core Engine", "replaces", "Old Mill")}
    df = spark.createDataFrame([(1, "Revenue was $3.1 billion; revenue: 3100 million; growth of 12%; sales 2021")], "doc_id int, text string")
    assert {(r["metric"], r["value"], r["unit"], round(r["billions"], 6)) for r in E.metric_values(df, ["doc_id"]).collect()} == {("revenue", 3.1, "B", 3.1), ("revenue", 3100.0, "M", 3.1), ("growth", 12.0, "%", 12.0)}
    d = spark.createDataFrame([("2024-02-03T04:05:06",), ("2024-02-03",), ("2024-02",), ("2024",), ("no",)], "t string")
    t, p = E.parsed_date(F.col("t"))
    assert [r["p"] for r in d.select(t.alias("t"), p.alias("p")).collect()] == ["second", "day", "month", "year", None]
    lines = spark.createDataFrame([(1, 0, "Title", 20.0), (1, 1, "body", 10.0), (1, 2, "Part", 14.0), (1, 3, "text", 10.0), (1, 4, "more", 10.0), (1, 5, "Next", 19.0), (1, 6, "end", 10.0)], "doc int, at int, text string, size double")
    got = {r["at"]: (r["level"], r["path"]) for r in E.heading_paths(E.headings(lines, "doc", "size", "at"), "doc", "at", "text").collect()}
    assert got[0][0] == 1 and got[2][0] == 2 and got[3] == (None, "Title > Part") and got[6] == (None, "Next")
    table = spark.createDataFrame([([["a", "b"], ["1"]],)], "t array<array<string>>")
    assert table.select(E.table_text(F.col("t"))).collect()[0][0] == "a | b\n--- | ---\n1 | "
    assert table.select(E.looks_like_header(F.col("t")[0])).collect()[0][0]
    texts = spark.createDataFrame([(1, "we like the Core Engine, a lot"), (2, "core only")], "k int, text string")
    names = spark.createDataFrame([("e1", "Core Engine"), ("e2", "core")], "id string, name string")
    assert {tuple(r) for r in E.linked_entities(texts, names, "k").collect()} == {(1, "e1"), (1, "e2"), (2, "e2")}


def test_control(spark):
    s = spark.createDataFrame([(5, 3, 0.8, 1.0, 0), (5, 3, 0.8, 1.0, 1), (1, 1, 0.1, 0.1, 0), (2, 1, 0.2, 0.5, 0)], "found int, sources int, top3 double, cov double, con int")
    got = [r[0] for r in s.select(planning.sufficiency(F.col("found"), F.col("sources"), F.col("top3"), F.col("cov"), F.col("con"))).collect()]
    assert got == ["strong", "conflicted", "insufficient", "marginal"]
    o = spark.createDataFrame([("x", 0, []), ("", 1, []), ("x", 1, ["synthesis_degraded_a"]), ("x", 1, ["assessment_fallback"]), ("x", 1, ["other"])], "a string, n int, w array<string>")
    assert [r[0] for r in o.select(planning.outcome(F.col("a"), F.col("n"), F.col("w"))).collect()] == ["not_found", "no_answer", "answered_degraded", "answered_fallback", "answered"]
    from weftlight.operators import needs

    top = lambda text: one(spark, needs.topics, text)
    assert top("Assess the storage layer and explain the failure modes; list every owner") == ["assess storage layer", "failure modes", "list owner"]
    assert top("How do Atlas costs and Beacon margins move") == ["How do Atlas costs", "Beacon margins move"] and top("Is it so?") == [""]
    assert one(spark, needs.entities, "Does PetroX supply Acme Corp? Acme Corp says PetroX and The Mill do.") == ["Does PetroX", "Acme Corp", "PetroX", "The Mill"]
