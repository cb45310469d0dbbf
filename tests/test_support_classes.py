"""All classes of claim support, by hand: citations first, then numbers, then the share of key terms."""

from pyspark.sql import functions as F

from weftlight.operators.verification import claim_support

CASES = [
    ("Revenue grew $10M in Berlin [1]", [1], ["Revenue grew 10,000K in Berlin"], "supported"),
    ("Revenue grew 10 million in Berlin [1]", [1], ["Revenue grew 10 million in Berlin"], "partially_supported"),  # a spelled unit has no value to match
    ("Revenue grew 10 million", [1], ["Revenue grew 12 million"], "partially_supported"),
    ("Revenue grew 10 million", [1], ["Weather stayed cold 12"], "unsupported"),
    ("Revenue grew 10.04", [1, 2], ["Revenue rose", "grew 10.0"], "supported"),  # within one percent, from the second text
    ("alpha beta gamma delta omega", [1], ["alpha beta gamma"], "supported"),  # 3 of 5
    ("alpha beta gamma delta omega", [1], ["alpha beta"], "partially_supported"),  # 2 of 5
    ("alpha beta gamma delta omega", [1], ["alpha"], "unsupported"),  # 1 of 5
    ("alpha beta gamma", [1], ["alpha"], "partially_supported"),  # 1 of 3
    ("alpha beta gamma", [], ["alpha beta gamma"], "no_citation"),
    ("alpha beta gamma", [1, 7], ["alpha beta gamma"], "invalid_citation"),
    ("alpha beta gamma", [0], ["alpha beta gamma"], "invalid_citation"),
    ("alpha beta gamma", [2], [], "unsupported"),
]


def test_classes(spark):
    rows = [(i, c, ids, texts) for i, (c, ids, texts, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, claim string, ids array<int>, texts array<string>")
    got = {r["i"]: r["s"] for r in df.select("i", claim_support(F.col("claim"), F.col("ids"), F.col("texts"), F.lit(6)).alias("s")).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(CASES)}
