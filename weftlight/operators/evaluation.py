"""Evaluation: ranking metrics, token F1, citations, claim support, answer quality, dispersion, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlight.functions import text as X


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(query, recall, precision, mrr, ndcg) of (query, item, rank) against (query, item) pairs; null without relevant items."""
    n = relevant.groupBy(query).agg(F.count(F.lit(1)).alias("n_relevant"))
    hit = ranked.filter(F.col("rank") <= k).join(relevant.withColumn("_hit", F.lit(1)), [query, item], "left")
    per = hit.groupBy(query).agg(
        F.coalesce(F.sum("_hit"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("returned"), F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("_hit") == 1, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
    )
    j = n.join(per, query, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        query, zero(F.col("hits") / F.col("n_relevant")).alias("recall"), zero(F.col("hits") / F.col("returned")).alias("precision"),
        zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"),
    )


def by_class(metrics: DataFrame, of: str, names: list[str], digits: int = 6) -> DataFrame:
    """Means per class and over all (class null), leaving out nulls, with the number of rows they apply to."""
    return metrics.rollup(of).agg(*[F.round(F.avg(n), digits).alias(n) for n in names], F.count(F.lit(1)).alias("n"), F.grouping(of).cast("int").alias("is_total"))


def token_f1(pairs: DataFrame, keys: list[str], predicted: str, gold: str) -> DataFrame:
    """(keys, precision, recall, f1) of two texts as multisets of tokens."""
    side = lambda c, n: pairs.select(*keys, F.explode(X.tokens(F.col(c))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias(n))
    both = side(predicted, "p").join(side(gold, "g"), [*keys, "term"], "full_outer")
    s = both.groupBy(*keys).agg(F.sum(F.least(F.coalesce("p", F.lit(0)), F.coalesce("g", F.lit(0)))).alias("c"), F.sum(F.coalesce("p", F.lit(0))).alias("p"), F.sum(F.coalesce("g", F.lit(0))).alias("g"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return s.select(*keys, ratio(F.col("c"), F.col("p")).alias("precision"), ratio(F.col("c"), F.col("g")).alias("recall"), ratio(2 * F.col("c"), F.col("p") + F.col("g")).alias("f1"))


def claims(answers: DataFrame, keys: list[str], text_col: str = "text", least: int = 10) -> DataFrame:
    """(keys, claim_no, claim): sentences of at least `least` characters; compound ones are cut at and, but and ;.

    Parts count only if there is more than one with a number or a capitalised word; markers stay with the last part.
    """
    s = answers.select(*keys, F.posexplode(F.filter(X.sentences(F.col(text_col)), lambda x: F.length(F.trim(x)) >= least)).alias("s_no", "sentence"))
    parts = F.filter(F.split(F.regexp_replace("sentence", r"\s*\[\d+\]", ""), r"\s+(?:and|but|;)\s+(?=[a-zA-Z])"), lambda p: p.rlike(r"[0-9]|(^|\s)[A-Z][a-z]"))
    marks = F.array_join(F.regexp_extract_all("sentence", F.lit(r"(\[\d+\])"), 1), "")
    cut = s.withColumn("p", parts).withColumn("m", marks)
    made = F.when(F.size("p") > 1, F.transform("p", lambda x, i: F.when(i == F.size("p") - 1, F.concat(F.trim(x), F.col("m"))).otherwise(F.trim(x)))).otherwise(F.array(F.trim("sentence")))
    e = cut.select(*keys, "s_no", F.posexplode(made).alias("p_no", "claim"))
    return e.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("s_no", "p_no")) - 1).alias("claim_no"), "claim")


def support(claims_df: DataFrame, citations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, claim_no, claim, status): claims against the texts their markers name, (keys, position, text).

    no_citation, invalid_citation (no marker resolves), unsupported if a number of the claim is in none of the texts, then
    supported from an overlap of 0.6 of the key terms, partial from 0.3, else unsupported.
    """
    c = claims_df.withColumn("ids", F.array_distinct(X.citation_ids(F.col("claim")))).withColumn("terms", X.key_terms(X.without_citations(F.col("claim")))).withColumn("nums", F.filter(F.transform(X.numbers(F.col("claim")), X.number_value), lambda v: v.isNotNull()))
    e = c.select(*keys, "claim_no", F.explode_outer("ids").alias("position"))
    t = citations.select(*keys, "position", F.col("text").alias("_x"))
    hit = e.join(t, [*keys, "position"], "left").groupBy(*keys, "claim_no").agg(F.concat_ws(" ", F.collect_list("_x")).alias("_x"), F.count("_x").alias("found"), F.count("position").alias("named"))
    j = c.join(hit, [*keys, "claim_no"])
    have = F.filter(F.transform(X.numbers(F.col("_x")), X.number_value), lambda v: v.isNotNull())
    lost = F.exists("nums", lambda a: ~F.exists(have, lambda b: X.numbers_match(a, b)))
    share = X.coverage(F.col("terms"), X.key_terms(F.col("_x")))
    status = F.when(F.col("named") == 0, "no_citation").when(F.col("found") == 0, "invalid_citation").when(lost, "unsupported").when(share >= 0.6, "supported").when(share >= 0.3, "partial").otherwise("unsupported")
    return j.select(*keys, "claim_no", "claim", status.alias("status"), F.round(share, 6).alias("overlap"))


def answer_quality(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_claims, support, citation_presence, citation_validity): the roll-up of support()."""
    n = F.count(F.lit(1))
    cited = F.count_if(F.col("status") != "no_citation")
    value = F.sum(F.when(F.col("status") == "supported", 1.0).when(F.col("status") == "partial", 0.5 * F.col("overlap")).when(F.col("status") == "contradicted", -0.5).otherwise(0.0))
    return statuses.groupBy(*keys).agg(
        n.alias("n_claims"), F.round(F.greatest(F.lit(0.0), value / n), 6).alias("support"), F.round(cited / n, 6).alias("citation_presence"),
        F.round(F.when(cited > 0, F.count_if(~F.col("status").isin("no_citation", "invalid_citation")) / cited), 6).alias("citation_validity"),
    )


def dispersion(scores: DataFrame, group: str, score: str) -> DataFrame:
    """(group, n, cv): sample deviation over mean for groups of three or more."""
    return scores.groupBy(group).agg(F.count(score).alias("n"), (F.stddev_samp(score) / F.avg(score)).alias("cv")).filter("n >= 3")


def confidence(coverage: Column, agreement: Column, contradictions: Column) -> Column:
    """conflicted, high, medium or low."""
    return F.when(contradictions > 0, "conflicted").when((coverage >= 0.8) & (agreement >= 0.7), "high").when(coverage >= 0.5, "medium").otherwise("low")


def _mean(c: str, digits: int) -> Column:
    return F.round(F.avg(c), digits).alias(c)


def item_scores(items: DataFrame, key: str) -> DataFrame:
    """The scores of answered benchmark items; null where a score does not apply.

    items: answer, cited (ids in citation order), gold (ids), expects_contradiction, detected, gold_years (strings),
    adversarial, distractors (ids), metadata (map of strings).
    """
    refs = F.transform(F.regexp_extract_all("answer", F.lit(r"\[\s*(\d+)\s*\]"), 1), lambda x: x.cast("int"))
    resolved = F.transform(F.filter(refs, lambda r: (r >= 1) & (r <= F.size("cited"))), lambda r: F.element_at("cited", r))
    gold = lambda x: F.size(F.filter(x, lambda c: F.array_contains("gold", c)))
    share = lambda x: F.when(F.size(x) == 0, 0.0).otherwise(gold(x) / F.size(x))
    known = lambda k: F.col("metadata")[k].try_cast("double")
    return items.select(
        key, share(resolved).alias("citation_correctness"), share(F.col("cited")).alias("evidence_precision"), F.when(F.size("gold") > 0, gold(F.col("cited")) / F.size("gold")).alias("recall"),
        F.when(F.col("expects_contradiction"), F.col("detected").cast("int").cast("double")).alias("contradiction_recall"),
        F.when(F.size("gold_years") > 0, F.exists("gold_years", lambda y: F.contains("answer", y)).cast("int").cast("double")).alias("temporal_accuracy"),
        F.when(F.col("adversarial"), (~F.arrays_overlap("cited", "distractors")).cast("int").cast("double")).alias("adversarial_robustness"),
        known("vault_personalization_gain").alias("vault_personalization_gain"), known("reindex_duration_ms").alias("reindex_cost"), known("write_back_usefulness").alias("write_back_usefulness"),
    )


def applicable_means(scores: DataFrame, of: list[str], names: list[str], digits: int = 6) -> DataFrame:
    """(of, metric, value, applicable): the mean of each score over the rows that it applies to, and how many they are."""
    long = scores.unpivot(of, names, "metric", "v")
    return long.groupBy(*of, "metric").agg(F.round(F.avg("v"), digits).alias("value"), F.count("v").alias("applicable"))


def variant_deltas(values: DataFrame, reference: str, digits: int = 4) -> DataFrame:
    """(variant, metric, delta) against the reference variant's value; null if either has none."""
    r = values.filter(F.col("variant") == reference).select("metric", F.col("value").alias("_r"))
    known = lambda c: F.when(~F.isnan(c), c)
    return values.join(r, "metric").select("variant", "metric", F.round(known(F.col("value")) - known(F.col("_r")), digits).alias("delta"))


def retrieval_report(cases: DataFrame, of: str, digits: int = 4) -> DataFrame:
    """Per class and over all (class null): means of what applies, and precision, recall and abstention from counts.

    cases: recall, precision, coverage (null if they do not apply), signals, conflict_expected, absent_trigger, absent_expected.
    """
    fired = F.col("signals") > 0
    tp, fp, fn = (F.count_if(c) for c in (F.col("conflict_expected") & fired, ~F.col("conflict_expected") & fired, F.col("conflict_expected") & ~fired))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), digits)
    return cases.rollup(of).agg(
        F.count(F.lit(1)).alias("n"), _mean("recall", digits), _mean("precision", digits), _mean("coverage", digits), ratio(tp, tp + fp).alias("contradiction_precision"), ratio(tp, tp + fn).alias("contradiction_recall"),
        ratio(F.count_if(F.col("absent_expected") & F.col("absent_trigger")), F.count_if("absent_expected")).alias("abstention"), F.grouping(of).cast("int").alias("is_total"),
    )


def grounded_sentences(answers: DataFrame, evidence: DataFrame, key: str, position: str, text_col: str = "answer") -> DataFrame:
    """(key, sentences, grounded, rate): sentences that cite a gold text or share half their tokens with a cited gold text.

    evidence: key, position (from 1), text, gold (boolean).
    """
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))
    g = evidence.filter("gold").groupBy(key).agg(F.collect_set(position).alias("_p"), F.collect_list(tokens(F.col("text"))).alias("_t"))
    s = answers.select(key, F.explode(F.filter(F.transform(F.split(text_col, r"(?<=[.!?])\s+"), F.trim), lambda x: x != "")).alias("s")).join(g, key, "left")
    refs = F.transform(F.regexp_extract_all("s", F.lit(r"\[\s*(\d+)\s*\]"), 1), lambda x: x.cast("int"))
    mine = tokens(F.col("s"))
    alike = F.exists("_t", lambda t: F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, t)) / F.size(mine) >= 0.5).otherwise(False))
    ok = F.coalesce(F.arrays_overlap(refs, F.col("_p")), F.lit(False)) | F.coalesce(alike, F.lit(False))
    return s.groupBy(key).agg(F.count(F.lit(1)).alias("sentences"), F.count_if(ok).alias("grounded")).withColumn("rate", F.col("grounded") / F.col("sentences"))
