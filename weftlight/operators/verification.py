"""Claims against evidence: status, gaps, confidence, counts, rendering, gold facts, results with citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlight.functions import text as X

NOTHING = "The available evidence does not contain sufficient information to answer this question."
#: Order in which kinds of claims are told, and the weight of source types (fixed values).
TOLD = ["factual", "numerical", "comparison", "relationship"]
SOURCE_WEIGHT = {"pdf": 0.9, "markdown": 0.7, "text": 0.6, "html": 0.5, "other": 0.5}
# Words that show what a question is after, in order.
PATTERN_WORDS = [
    ("simple_lookup", ["where is", "what is the name", "who is", "when was", "how many employees"]), ("numerical", ["latency", "p99", "revenue growth rate", "percentage", "ratio"]),
    ("conflict", ["conflict", "different sources", "disagreement", "discrepancies"]), ("absent_info", ["not contain", "not available", "no information", "undisclosed"]),
]


def long_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{4,})"), 1))


def verify_claims(claims: DataFrame, evidence: DataFrame, key: str, position: str, text_col: str = "text") -> DataFrame:
    """claims with valid_ids, overlap and status.

    claims: key, claim_no, claim_type, claim, evidence_ids, numerical_values; evidence: key, position (from 1), text.
    Without a valid id unsupported; absent claims and those without a word of four letters are supported; an overlap with
    the words of the named evidence under 0.2 is partial; numbers that are not in it make a numerical claim unsupported.
    """
    texts = evidence.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(position, F.lower(text_col).alias("t")))).alias("_m"))
    j = claims.join(texts, key, "left").withColumn("_m", F.coalesce("_m", F.create_map().cast("map<int,string>")))
    j = j.withColumn("valid_ids", F.filter("evidence_ids", lambda i: F.coalesce((i >= 1) & F.map_contains_key("_m", i), F.lit(False))))
    j = j.withColumn("_x", F.array_join(F.transform("valid_ids", lambda i: F.element_at("_m", i)), " "))
    w = long_words(F.col("claim"))
    share = F.when(F.size(w) > 0, F.size(F.array_intersect(w, long_words(F.col("_x")))) / F.size(w)).otherwise(0.0)
    j = j.withColumn("_n", F.size(w)).withColumn("overlap", share)
    lost = (F.col("claim_type") == "numerical") & F.exists(F.coalesce("numerical_values", F.array().cast("array<string>")), lambda v: (v != "") & ~F.contains(F.col("_x"), v))
    status = (
        F.when(F.size("valid_ids") == 0, "unsupported").when((F.col("claim_type") == "absent") | (F.col("_n") == 0), "supported").when(F.col("overlap") < 0.2, "partially_supported")
        .when(lost, "unsupported").otherwise("supported")
    )
    return j.withColumn("status", status).drop("_m", "_x", "_n")


def render(verified: DataFrame, key: str) -> DataFrame:
    """(key, answer): supported claims by kind with their citations, contradicted ones first; an absent claim speaks alone."""
    cites = F.array_join(F.transform(F.filter("evidence_ids", lambda i: (i >= 1) & (i <= 99)), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), "")
    line = F.concat("claim", F.lit(" "), cites)
    good = F.col("status").isin("supported", "partially_supported")
    kind = F.array_position(X.literal_array(TOLD), F.col("claim_type"))
    ordered = lambda cond, x, *by: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(*by, "claim_no", x.alias("x"))))), lambda s: s["x"])
    g = verified.withColumn("_k", kind).groupBy(key).agg(
        ordered(good & (F.col("_k") > 0), line, "_k").alias("told"), ordered(F.col("status") == "contradicted", F.concat(F.lit("- "), line)).alias("against"),
        ordered(good & (F.col("claim_type") == "absent"), F.col("claim")).alias("absent"), F.count_if(good).alias("n"),
    )
    opened = F.when(F.size("against") > 0, F.concat(F.array(F.lit("The evidence contains conflicting information:")), "against", F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(opened, "told")
    answer = F.when((F.col("n") == 0) & (F.size("against") == 0), NOTHING).when(F.size("absent") > 0, F.col("absent")[0]).when(F.size(parts) == 0, NOTHING).otherwise(F.array_join(parts, " "))
    return g.select(key, answer.alias("answer"))


def answer_pattern(question: Column) -> Column:
    low, out = F.lower(question), F.lit("general")
    for name, listed in reversed(PATTERN_WORDS):
        out = F.when(X.any_in(low, listed), name).otherwise(out)
    return out


def early_exit(verified: DataFrame, questions: DataFrame, key: str, text_col: str = "text", most: int = 10) -> DataFrame:
    """(key, claims, supported, rejected, pattern, early): whether claims can be rendered without a further pass."""
    n = verified.groupBy(key).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status").isin("supported", "partially_supported")).alias("supported"), F.count_if(~F.col("status").isin("supported", "partially_supported")).alias("rejected"))
    j = n.join(questions.select(key, answer_pattern(F.col(text_col)).alias("pattern")), key)
    early = (F.col("rejected") == 0) & (F.col("supported") <= most) & (F.col("pattern").isin("simple_lookup", "numerical", "absent_info") | ((F.col("pattern") == "conflict") & (F.col("supported") <= 5)))
    return j.select(key, "claims", "supported", "rejected", "pattern", early.alias("early"))


def confidence_components(claims: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, evidence_coverage, source_quality, cross_source_agreement, temporal_relevance, retrieval_rank, verifier_judgment, composite).

    claims: key, subject, object, valid_from, verifier_judgment; evidence: key, supports, score, source, source_type.
    """
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHT.items() for x in kv])[F.lower("source_type")], F.lit(0.5))
    s = F.col("supports")
    g = evidence.groupBy(key).agg(
        F.count_if(s).alias("_s"), F.count_if(~s).alias("_c"), F.avg(F.when(s, F.col("score") * weight)).alias("_q"), F.countDistinct(F.when(s, F.col("source"))).alias("_d"), F.avg(F.when(s, F.col("score"))).alias("_r")
    )
    j = claims.join(g, key, "left")
    n, zero = F.coalesce(F.col("_s") + F.col("_c"), F.lit(0)), F.lit(0.0)
    factor = F.when(F.col("subject").isNotNull() & F.col("object").isNotNull(), 0.8).when(F.col("subject").isNotNull(), 0.9).otherwise(1.0)
    any_ = F.coalesce(F.col("_s"), F.lit(0)) > 0
    parts = {
        "evidence_coverage": F.when(n == 0, zero).otherwise(F.least(F.lit(1.0), F.col("_s") / n * factor)), "source_quality": F.coalesce("_q", zero),
        "cross_source_agreement": F.when(n == 0, zero).otherwise(F.least(F.lit(1.0), F.col("_s") / n + F.least(F.lit(0.2), F.col("_d") * 0.05))),
        "temporal_relevance": F.when(~any_, zero).when(F.col("valid_from").isNull(), 0.7).otherwise(1.0), "retrieval_rank": F.least(F.lit(1.0), F.coalesce("_r", zero)), "verifier_judgment": F.col("verifier_judgment"),
    }
    j = j.select(key, *[c.alias(x) for x, c in parts.items()])
    return j.withColumn("composite", sum((F.col(x) for x in parts), F.lit(0.0)) / 6)


def claim_gaps(results: DataFrame, key: str, claim: str = "claim") -> DataFrame:
    """(key, gap_type, suggested_query, priority) of claims (status, evidence_coverage, source_quality, temporal_relevance)."""
    gap = lambda kind, head, p: F.struct(F.lit(kind).alias("gap_type"), F.concat(F.lit(head), F.col(claim)).alias("suggested_query"), F.lit(p).alias("priority"))
    partial = F.col("status") == "partial"
    rules = [
        F.when(F.col("status") == "unsupported", gap("no_evidence", "Evidence for: ", 0.9)), F.when(partial & (F.col("evidence_coverage") < 0.5), gap("partial_coverage", "Evidence for: ", 0.7)),
        F.when(partial & (F.col("source_quality") < 0.5), gap("source_quality", "Authoritative sources for: ", 0.6)), F.when(partial & (F.col("temporal_relevance") < 0.5), gap("temporal_mismatch", "Recent evidence for: ", 0.6)),
        F.when(F.col("status") == "contradicted", gap("contradiction_resolution", "Resolving contradictory evidence for: ", 0.8)),
    ]
    return results.select(key, F.inline(F.filter(F.array(*rules), lambda x: x.isNotNull())))


def batch_counts(results: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, supported, partial, contradicted, unsupported, error)."""
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("supported", "partial", "contradicted", "unsupported", "error")])


def negated_fact(answer: Column, fact: Column) -> Column:
    """Whether the answer denies the fact: it shares key terms with it and negates, or negates within 30 characters before it."""
    low, f = F.lower(answer), F.lower(fact)
    at = F.instr(low, f)
    first = F.regexp_extract(X.masked_ascii(low), rf"^(.*?\b(?:{X.NEGATIONS})\b)", 1)
    near = (at > 0) & (first != "") & (at - 1 - F.length(first) < 30)
    return (F.arrays_overlap(X.key_terms(fact), X.key_terms(answer)) & X.has_negation(answer)) | near


def gold_facts(answers: DataFrame, facts: DataFrame, keys: list[str], answer: str, fact: str) -> DataFrame:
    """(keys, fact, status): negated, found (as it stands, or by 0.7 of its key terms) or missing."""
    j = answers.select(*keys, F.col(answer).alias("_a")).join(facts.select(*keys, F.col(fact).alias("fact")), keys)
    a, f = F.col("_a"), F.col("fact")
    terms = X.key_terms(f)
    status = F.when(negated_fact(a, f), "negated").when(F.contains(F.lower(a), F.lower(f)), "found").when((F.size(terms) > 0) & (X.coverage(terms, X.key_terms(a)) >= 0.7), "found").otherwise("missing")
    return j.select(*keys, "fact", status.alias("status"))


def claim_support(claim: Column, ids: Column, texts: Column, total: Column) -> Column:
    """no_citation, invalid_citation (any id out of range), supported, partially_supported or unsupported.

    Numbers of a claim must all be in the texts; else it is partial from an overlap of 0.5 of the key terms. Without
    numbers the overlap decides, 0.6 and 0.3.
    """
    bare = X.without_citations(claim)
    raw, have = X.numbers(bare), F.flatten(F.transform(texts, X.numbers))
    found = F.forall(raw, lambda a: F.exists(have, lambda b: X.numbers_match(X.number_value(a), X.number_value(b))))
    terms = X.key_terms(bare)
    share = F.size(F.array_intersect(terms, F.flatten(F.transform(texts, X.key_terms)))) / F.greatest(F.size(terms), F.lit(1))
    by_number = F.when(share >= 0.5, "partially_supported").otherwise("unsupported")
    return (
        F.when(F.size(ids) == 0, "no_citation").when(F.exists(ids, lambda i: (i < 1) | (i > total)), "invalid_citation").when(F.size(texts) == 0, "unsupported").when(F.size(terms) == 0, "supported")
        .when((F.size(raw) > 0) & ~found, by_number).when(share >= 0.6, "supported").when(share >= 0.3, "partially_supported").otherwise("unsupported")
    )


def cited_evidence(answers: DataFrame, evidence: DataFrame, key: str, position: str, text_col: str = "answer", fallback: int = 3) -> DataFrame:
    """(key, ref, position, fallback): evidence that an answer names, in first-seen order; without any its first ones."""
    n = evidence.groupBy(key).agg(F.max(position).alias("_n"))
    a = answers.select(key, F.array_distinct(X.citation_ids(F.col(text_col))).alias("_i")).join(n, key)
    a = a.withColumn("_i", F.filter("_i", lambda i: (i >= 1) & (i <= F.col("_n")))).withColumn("fallback", F.size("_i") == 0)
    listed = F.when(F.col("fallback"), F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(fallback)).cast("int"))).otherwise(F.col("_i"))
    return a.select(key, "fallback", F.posexplode(listed).alias("ref", position)).join(evidence.select(key, position), [key, position]).select(key, (F.col("ref") + 1).alias("ref"), position, "fallback")


def grounding(evidence: DataFrame, key: str, order: str) -> DataFrame:
    """(key, best, mean, top3, uncertain): best score, mean, mean of the first three by `order`, mean under 0.5."""
    r = evidence.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return r.groupBy(key).agg(F.max("score").alias("best"), F.avg("score").alias("mean"), F.avg(F.when(F.col("_r") <= 3, F.col("score"))).alias("top3"), (F.avg("score") < 0.5).alias("uncertain"))


def adjusted_tier(tier: Column, found: Column, top3: Column) -> Column:
    """The tier after evidence is seen: never a dearer one; three scores are needed."""
    return F.when((tier == "fast") | (found < 3), tier).when(top3 >= 0.75, "fast").when((top3 >= 0.6) & (tier == "strong"), "balanced").otherwise(tier)


def active_roles(found: Column, risk: Column, best: Column, mean: Column, spread: Column, skip: Column, skeptic: float = 0.5, apart: float = 0.3) -> Column:
    """The roles that debate a question: researcher and judge alone if verification may be skipped, doubters if evidence is weak."""
    doubt = F.coalesce(risk.isin("medium", "high"), F.lit(False)) | ((found > 0) & (F.coalesce(spread > apart, F.lit(False)) | (mean < 0.5) | (mean < skeptic)))
    full = F.array(*[F.lit(x) for x in ("researcher", "verifier", "skeptic", "alternative_hypothesis", "judge")])
    return F.when(skip, F.array(F.lit("researcher"), F.lit("judge"))).when(doubt, full).otherwise(F.array(F.lit("researcher"), F.lit("verifier"), F.lit("judge")))


def disagreement(severity: Column, distinct: Column, contradicted: Column, unsupported: Column, apart: float = 0.3) -> Column:
    """Whether a round of debate disagrees; null severities are of roles that did not speak."""
    spoke = severity.isNotNull() | distinct.isNotNull()
    zero = F.lit(0.0)
    return spoke & ((F.coalesce(severity, zero) >= apart) | (F.coalesce(distinct, zero) >= apart) | (contradicted > 0) | (unsupported >= 2))
