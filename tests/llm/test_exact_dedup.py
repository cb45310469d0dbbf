from weftlight.llm.exact_dedup import distinct_documents, exact_duplicates

ROWS = [(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, "", "z"), (5, "b", None), (5, "b", None), (None, "a", "q"), (None, "c", "q"), (7, "A", "q")]


def test_groups(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string").repartition(3)
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_duplicates(df).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (None, None, 1, True), (7, 7, 1, True)}
    assert exact_duplicates(df).count() == len(ROWS)
    small = {r["keep_id"] for r in exact_duplicates(df, keep="smallest").collect()}
    assert small == {1, 3, 5, 7, None}


def test_one_row_of_each_group_stays(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string").repartition(3)
    got = distinct_documents(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2, "a", "y"), (4, "", "z"), (5, "b", None), (None, "c", "q"), (7, "A", "q")], key=str)
    assert distinct_documents(df.limit(0)).count() == 0 == exact_duplicates(df.limit(0)).count()


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, k string")
    plan = exact_duplicates(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
