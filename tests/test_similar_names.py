from weftlight.operators.extraction import similar_names


def test_names_that_differ_in_their_first_letters_are_met(spark):
    a = spark.createDataFrame([(1, "Kohnson Brothers"), (2, "ab"), (3, "x"), (4, "hte long company name"), (5, None)], "id long, name string")
    b = spark.createDataFrame([(1, "johnson brothers"), (2, "AB"), (3, "X"), (4, "the long company name"), (5, None)], "id long, name string")
    assert {(r["a"], r["b"]) for r in similar_names(a, b).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}
