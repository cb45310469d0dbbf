"""Contradictions between pieces of a question's evidence and between typed claims; kinds, confidence, relevance to the question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlight.functions import text as X
from weftlight.operators import extraction

# Opposites of which one side in each of two texts speaks for a contradiction.
OPPOSITES = [
    ("is", "is not"), ("is", "isn't"), ("was", "was not"), ("was", "wasn't"), ("are", "are not"), ("are", "aren't"), ("can", "can not"), ("can", "can't"), ("will", "will not"), ("will", "won't"),
    ("does", "does not"), ("does", "doesn't"), ("did", "did not"), ("did", "didn't"), ("has", "has not"), ("has", "hasn't"), ("have", "have not"), ("have", "haven't"), ("no ", "yes "),
    ("true", "false"), ("confirmed", "denied"), ("possible", "impossible"), ("safe", "unsafe"), ("increase", "decrease"), ("rise", "fall"), ("higher", "lower"), ("more", "less"),
    ("supports", "contradicts"), ("contains", "does not contain"), ("supports", "does not support"), ("support", "does not support"),
]
# Capitalised words that are no names; words of a question that are no topics; words that show what it is after.
NO_NAMES = ["the", "and", "for", "with", "from", "this", "that", "report", "annual", "fiscal", "total", "combined"]
QUESTION_WORDS = ["what", "which", "when", "where", "does", "that", "have", "been", "from", "about", "how", "many", "was", "were"]
CONFLICT_INTENT = ["conflict", "contradict", "discrepan", "differ", "disagree", "inconsistent", "versus", "vs"]
HISTORY_INTENT = ["history", "historical", "trend", "over time", "change", "compare", "comparison", "before", "after"]
GEOGRAPHIC = ["country", "state", "city", "region", "province", "district", "jurisdiction", "national", "federal", "local", "global", "international"]


def quarters(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(X.masked_ascii(text), F.lit(r"(?i)\bQ([1-4])\b"), 1), lambda q: F.concat(F.lit("Q"), q))))


def as_of_year(text: Column) -> Column:
    """The first year after `as of`; null without one."""
    return F.nullif(F.regexp_extract(X.masked_ascii(text), r"\bas of\b.*?\b(20[0-9]{2})\b", 1), F.lit("")).try_cast("int")


def name_words(text: Column) -> Column:
    """Distinct capitalised words of three letters and more, in lower case, without some that are no names."""
    return F.array_except(F.array_distinct(F.transform(F.regexp_extract_all(X.masked_ascii(text), F.lit(r"\b([A-Z][a-z]{2,})\b"), 1), F.lower)), X.literal_array(NO_NAMES))


def long_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{4,})"), 1))


def metric_words(text: Column) -> Column:
    return F.array_intersect(long_words(text), X.literal_array(X.METRICS))


def _sides(low: Column, side: int) -> Column:
    """Which of the opposites' sides a text holds."""
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(p[side])), F.lit(i)) for i, p in enumerate(OPPOSITES)]), lambda x: x.isNotNull())


def conflict_type(years_i: Column, years_j: Column, names: Column, metrics: Column) -> Column:
    """What kind of difference two texts show, from their years and whether they share names and metrics."""
    both, same_time = (F.size(years_i) > 0) & (F.size(years_j) > 0), F.arrays_overlap(years_i, years_j)
    one = ((F.size(years_i) > 0) | (F.size(years_j) > 0)) & ~both
    return (
        F.when((names & both & ~same_time) | (names & one & metrics), "DIFFERENT_TIMEFRAME").when(names & same_time & metrics, "GENUINE_CONTRADICTION")
        .when(~names & metrics, "DIFFERENT_SOURCE").when(names & metrics, "POSSIBLE_CONTRADICTION").otherwise("IRRELEVANT_DIFFERENCE")
    )


def conflict_confidence(years_i: Column, years_j: Column, names: Column, metrics: Column, severity: Column) -> Column:
    same_time = F.arrays_overlap(years_i, years_j) | ((F.size(years_i) == 0) & (F.size(years_j) == 0))
    return F.when(names & same_time & metrics & (severity >= 0.8), "HIGH").when(names & metrics & (severity >= 0.5), "MEDIUM").otherwise("LOW")


def evidence_pairs(evidence: DataFrame, question: str, rank: str, text_col: str = "text") -> DataFrame:
    """(question, i, j, severity, conflict_type, confidence, names, metrics): contradictory pairs i < j of a question's evidence.

    Both need a shared name and three shared words. Opposite words make a pair of severity 1.0; else values of a shared
    metric of which none agrees make one of 0.8. A pair gives one row. Evidence is the few hits of each question: pairs
    grow with the hits of one question, never with the corpus.
    """
    low = F.lower(F.col(text_col))
    c = evidence.select(
        question, F.col(rank).alias("n"), X.years(X.masked_ascii(F.col(text_col))).alias("y"), name_words(F.col(text_col)).alias("e"), metric_words(F.col(text_col)).alias("m"),
        X.terms(F.col(text_col), 4, X.RELEVANCE_STOP).alias("w"), _sides(low, 0).alias("a"), _sides(low, 1).alias("b"),
    )
    values = extraction.metric_values(evidence.select(question, F.col(rank).alias("n"), low.alias("text")), [question, "n"]).filter("value > 0")
    c = c.join(_value_maps(values, question), [question, "n"], "left")
    side = lambda s: c.select(question, *[F.col(x).alias(x + s) for x in ("n", "y", "e", "m", "w", "a", "b", "v")])
    p = side("i").join(side("j"), question).filter("ni < nj")
    names, metrics = F.array_intersect("ei", "ej"), F.array_intersect("mi", "mj")
    p = p.withColumn("names", F.array_sort(names)).withColumn("metrics", F.array_sort(metrics)).filter((F.size("names") > 0) & (F.size(F.array_intersect("wi", "wj")) >= 3))
    opposed = F.arrays_overlap("ai", "bj") | F.arrays_overlap("bi", "aj")
    apart = F.exists("metrics", lambda m: F.coalesce(~F.arrays_overlap(F.col("vi")[m], F.col("vj")[m]), F.lit(False)))
    p = p.withColumn("severity", F.when(opposed, 1.0).when(apart, 0.8)).filter("severity is not null")
    yes, some = F.lit(True), F.size("metrics") > 0
    kind, sure = conflict_type(F.col("yi"), F.col("yj"), yes, some), conflict_confidence(F.col("yi"), F.col("yj"), yes, some, F.col("severity"))
    return p.select(question, F.col("ni").alias("i"), F.col("nj").alias("j"), "severity", kind.alias("conflict_type"), sure.alias("confidence"), F.slice("names", 1, 3).alias("names"), F.slice("metrics", 1, 3).alias("metrics"))


def _value_maps(values: DataFrame, question: str) -> DataFrame:
    """(question, n, v): the values of each metric of a text on one scale."""
    scale = F.when(F.col("unit") == "M", 0.001).when(F.col("unit") == "K", 0.000001).otherwise(1.0)
    per = values.groupBy(question, "n", "metric").agg(F.collect_set(F.col("value") * scale).alias("vs"))
    return per.groupBy(question, "n").agg(F.map_from_entries(F.collect_list(F.struct("metric", "vs"))).alias("v"))


def relevant_conflicts(conflicts: DataFrame, questions: DataFrame, question: str, text_col: str = "text") -> DataFrame:
    """The conflicts that matter to their question.

    Different times only if it asks for history or the metric; low confidence only if it asks for conflicts; a question
    that names metrics must share one, another must ask for conflicts or history; its other words must meet a name or metric.
    """
    low = F.lower(F.col(text_col))
    w = F.array_except(F.array_distinct(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]{4,})"), 1)), X.literal_array(QUESTION_WORDS))
    q = questions.select(question, w.alias("_w"), F.array_intersect(w, X.literal_array(X.METRICS)).alias("_m"), X.any_in(low, CONFLICT_INTENT).alias("_c"), X.any_in(low, HISTORY_INTENT).alias("_h"))
    j = conflicts.join(q, question)
    metric = F.arrays_overlap("metrics", "_m")
    other = F.array_except("_w", X.literal_array(X.METRICS))
    keep = (
        ((F.col("conflict_type") != "DIFFERENT_TIMEFRAME") | F.col("_h") | metric) & ((F.col("confidence") != "LOW") | F.col("_c"))
        & F.when(F.size("_m") > 0, metric).otherwise(F.col("_c") | F.col("_h")) & ((F.size(other) == 0) | F.arrays_overlap("names", other) | metric)
    )
    return j.filter(keep).select(*conflicts.columns)


def values_by_year(chunks: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, metric, value, unit, year): metric values with the first year of their sentence, else of the chunk, else 0.

    A sentence ends at a full stop that no digit follows.
    """
    s = chunks.select(*keys, X.years(X.masked_ascii(F.col(text_col))).alias("_y"), F.posexplode(F.split(text_col, r"\.(?![0-9])")).alias("_s", "_t"))
    s = s.withColumn("_own", X.years(X.masked_ascii(F.col("_t")))).withColumn("year", F.coalesce(F.array_min("_own"), F.array_min("_y"), F.lit(0)))
    return extraction.metric_values(s, [*keys, "year"], "_t").select(*keys, "metric", "value", "unit", "year")


#: Where an attribute's value stands (fixed values): pattern with the number and unit as groups, category.
ATTRIBUTES = [
    (r"(?:revenue|sales|income)\s*(?:of|was|is|were|totaled?|reached|amounted?)\s*\$?([\d,]+\.?\d*)\s*(billion|million|thousand|%)?", "financial"),
    (r"\$?([\d,]+\.?\d*)\s*(billion|million|thousand)\s+in\s+(?:revenue|sales|income)", "financial"),
    (r"(?:employee|worker|staff|headcount)(?:s)?\s*(?:of|was|is|were|count\s+of)\s*([\d,]+)()", "workforce"),
    (r"([\d,]+)()\s+(?:employees?|workers?|staff)", "workforce"),
    (r"(?:utilization|capacity|rate)\s*(?:of|was|is|were|at|reached)\s*([\d,]+\.?\d*)\s*(%|percent)?", "operational"),
    (r"([\d,]+\.?\d*)()\s*%\s+(?:utilization|capacity)", "operational"),
    (r"(?:output|production|produced)\s*(?:of|was|is|were|at|reached)?\s*([\d,]+\.?\d*)\s*(million|thousand|units)?", "operational"),
    (r"(?:founded|established|incorporated)\s+(?:in|on)?\s*(\d{4})()", "founding_date"),
]


def _attribute(category: str):
    return lambda v, u: F.struct(F.lit(category).alias("category"), v.alias("value"), F.lower(F.coalesce(u, F.lit(""))).alias("unit"))


def attribute_claims(chunks: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, category, value, unit, unit_group): values of finance, workforce, operation and founding in a text."""
    parts = [F.zip_with(F.regexp_extract_all(text_col, F.lit("(?i)" + p), 1), F.regexp_extract_all(text_col, F.lit("(?i)" + p), 2), _attribute(c)) for p, c in ATTRIBUTES]
    e = chunks.select(*keys, F.explode(F.concat(*parts)).alias("a")).select(*keys, "a.*")
    group = F.when(F.col("unit").isin("%", "percent"), "percentage").when(F.col("unit").isin("billion", "million", "thousand", "$", "k", "m", "b"), "financial").otherwise("count")
    return e.filter("value <> ''").withColumn("unit_group", group)


def attribute_conflicts(claims: DataFrame, question: str, chunk: str, doc: str) -> DataFrame:
    """(question, a, b, category, value_a, value_b, severity): different values of one category and unit group in texts a < b of different documents."""
    c = claims.select(question, F.col(chunk).alias("x"), F.col(doc).alias("d"), "category", "unit_group", "value").distinct()
    a, b = c.toDF(question, "a", "da", "category", "unit_group", "value_a"), c.toDF(question, "b", "db", "category", "unit_group", "value_b")
    p = a.join(b, [question, "category", "unit_group"]).filter("a < b and da <> db and value_a <> value_b")
    return p.select(question, "a", "b", "category", "value_a", "value_b", F.lit(0.7).alias("severity"))


def claim_pairs(claims: DataFrame) -> DataFrame:
    """(a, b): claims a < b with one subject, one object, or like predicates and one object value. Three equi-joins, each pair once."""
    c = claims.select("id", "subject", "object", F.lower("object_value").alias("v"), extraction.predicate_group(F.col("predicate")).alias("p"))

    def on(*keys):
        k = c.dropna(subset=list(keys)).select("id", *keys)
        return k.withColumnRenamed("id", "a").join(k.withColumnRenamed("id", "b"), list(keys)).filter("a < b").select("a", "b")

    return on("subject").unionByName(on("object")).unionByName(on("p", "v")).distinct()


def claim_conflicts(claims: DataFrame, least: float = 0.3) -> DataFrame:
    """(a, b, kind, severity): the eight typed checks over overlapping claims.

    claims: id, text, subject, predicate, object, object_value, valid_from, valid_to, published_at, chunk_ids.
    """
    nums = F.transform(F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    money = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)(\d+(?:\.\d+)?)\s*(?:percent|%|dollars?|\$|million|billion|trillion)"), 1), lambda x: x.cast("double"))
    geo = F.filter(X.literal_array(GEOGRAPHIC), lambda g: F.contains(F.lower("text"), g))
    c = claims.select(
        "id", F.lower(F.trim("text")).alias("t"), "subject", extraction.predicate_group(F.col("predicate")).alias("p"), F.col("object_value").alias("v"), F.coalesce("object_value", F.col("object").cast("string")).alias("o"),
        "valid_from", "valid_to", "published_at", F.array_sort(F.array_distinct("chunk_ids")).alias("ids"), nums.alias("n"), money.alias("m"), geo.alias("g"),
    )
    side = lambda s: c.select(*[F.col(x).alias(f"{x}_{s}") for x in c.columns])
    j = claim_pairs(claims).join(side("a").withColumnRenamed("id_a", "a"), "a").join(side("b").withColumnRenamed("id_b", "b"), "b")
    two = lambda x: (F.col(f"{x}_a"), F.col(f"{x}_b"))
    same = lambda x: two(x)[0].eqNullSafe(two(x)[1])
    differ = lambda x: two(x)[0] != two(x)[1]
    like = F.col("p_a") == F.col("p_b")
    has = lambda x: (F.size(two(x)[0]) > 0) & (F.size(two(x)[1]) > 0)
    other = lambda x: F.lower(two(x)[0]) != F.lower(two(x)[1])
    ends = [F.coalesce("valid_to_a", "valid_from_a"), F.coalesce("valid_to_b", "valid_from_b")]
    checks = [
        ("publication_date", 0.7, (F.col("t_a") == F.col("t_b")) & differ("published_at")),
        ("metric_definition", 0.8, has("n") & same("subject") & (F.col("n_a")[0] != F.col("n_b")[0])),
        ("geographic_scope", 0.6, has("g") & differ("g") & same("subject")),
        ("time_period", 0.7, same("subject") & ((F.col("valid_to_a") < F.col("valid_from_b")) | (F.col("valid_to_b") < F.col("valid_from_a"))) & F.col("valid_to_a").isNotNull() & F.col("valid_to_b").isNotNull() & F.col("valid_from_a").isNotNull() & F.col("valid_from_b").isNotNull()),
        ("revised_numbers", 0.8, has("m") & same("subject") & like & differ("m") & differ("published_at")),
        ("entity_mismatch", 0.5, differ("subject") & like),
        ("source_conflict", 0.9, same("subject") & like & other("o") & differ("ids")),
        ("temporal_conflict", 0.8, same("subject") & like & other("v") & (F.col("valid_from_a") <= ends[1]) & (F.col("valid_from_b") <= ends[0])),
    ]
    found = F.filter(F.array(*[F.when(x, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for k, s, x in checks if s >= least]), lambda x: x.isNotNull())
    return j.select("a", "b", F.inline(found))
