"""Queries of claims, answers and evaluation over the reports: verification, rendering, confidence, scores, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlight.functions import text as X
from weftlight.operators import conflicts, evaluation, fusion, planning, verification
from weftlight.plans import frames
from weftlight.plans.evidence_queries import PATTERN, any_sql, sql_list, terms_sql
from weftlight.plans.planning_queries import PAIRS, REPORTS
from weftlight.plans.registry import query
from weftlight.plans.retrieval_queries import CH
from weftlight.plans.retrieval_queries import frame as channel_frame

V = verification
#: Claims of an answer: one on each report, some with ids, numbers or words that no evidence has. LIST is the engine's array.
_GEN = """gen AS (SELECT question, q_no, rank AS claim_no, CASE rank WHEN 1 THEN 'factual' WHEN 2 THEN 'numerical' WHEN 3 THEN 'comparison' WHEN 4 THEN 'relationship' WHEN 5 THEN 'numerical' ELSE CASE WHEN q_no % 8 = 0 THEN 'absent' ELSE 'factual' END END AS claim_type,
  CASE WHEN rank = 3 AND q_no % 3 = 0 THEN 'Entirely different sentences about weather patterns' WHEN rank = 4 AND q_no % 2 = 0 THEN 'So it is' ELSE split_part(text, '. ', 1) END AS claim,
  CASE WHEN rank = 2 THEN LIST(2, 9) WHEN rank = 3 THEN LIST(3, 4) WHEN rank = 4 AND q_no % 5 = 0 THEN LIST(0, 40) WHEN rank = 6 THEN LIST(6, 1) ELSE LIST(rank) END AS evidence_ids,
  CASE WHEN rank = 5 THEN CASE WHEN q_no % 2 = 0 THEN LIST('999999') ELSE LIST(CAST(year AS VARCHAR(4))) END ELSE LIST('') END AS numerical_values FROM reports)"""
GEN = f"{REPORTS}, {_GEN.replace('LIST(', 'list_value(')}"


def generated(t):
    return frames.frame(t, f"{frames.REPORTS}, {_GEN.replace('LIST(', 'array(')}", "gen")


def checked(t):
    return V.verify_claims(generated(t), frames.reports(t), "question", "rank")


WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{4,}}')"
CHECKED = f"""{GEN}, ex AS (SELECT question, claim_no, i, unnest(evidence_ids) AS e, generate_subscripts(evidence_ids, 1) AS i FROM (SELECT question, claim_no, evidence_ids, 0 AS i FROM gen) z), ev AS (SELECT ex.question, claim_no, list(e ORDER BY ex.i_1) AS valid_ids, string_agg(lower(text), ' ' ORDER BY ex.i_1) AS x FROM ex JOIN reports r ON r.question = ex.question AND r.rank = ex.e GROUP BY ALL),
  cw AS (SELECT gen.*, coalesce(valid_ids, []) AS valid_ids, coalesce(x, '') AS x, list_distinct({WORDS.format('claim')}) AS w FROM gen LEFT JOIN ev USING (question, claim_no)),
  co AS (SELECT *, CASE WHEN len(w) > 0 THEN len(list_intersect(w, {WORDS.format('x')})) / len(w) ELSE 0 END AS overlap FROM cw),
  ck AS (SELECT *, CASE WHEN len(valid_ids) = 0 THEN 'unsupported' WHEN claim_type = 'absent' OR len(w) = 0 THEN 'supported' WHEN overlap < 0.2 THEN 'partially_supported' WHEN claim_type = 'numerical' AND len(list_filter(numerical_values, lambda v: v <> '' AND NOT contains(x, v))) > 0 THEN 'unsupported' ELSE 'supported' END AS status FROM co)""".replace("SELECT question, claim_no, i, unnest(evidence_ids) AS e, generate_subscripts(evidence_ids, 1) AS i FROM (SELECT question, claim_no, evidence_ids, 0 AS i FROM gen) z", "SELECT question, claim_no, unnest(evidence_ids) AS e, generate_subscripts(evidence_ids, 1) AS i_1 FROM gen")


@query("structured_claim_verification", f"WITH {CHECKED} SELECT question, claim_no, claim_type, list_sort(valid_ids) AS valid_ids, round(overlap, 6) AS overlap, status FROM ck")
def _(t):
    return checked(t).select("question", "claim_no", "claim_type", F.array_sort("valid_ids").alias("valid_ids"), F.round("overlap", 6).alias("overlap"), "status")


@query("deterministic_rendering", f"""WITH {CHECKED}, ln AS (SELECT *, claim || ' ' || array_to_string(list_transform(list_filter(evidence_ids, lambda i: i BETWEEN 1 AND 99), lambda i: '[' || i || ']'), '') AS line, list_position({sql_list(V.TOLD)}, claim_type) AS k FROM ck WHERE status IN ('supported', 'partially_supported')),
  gr AS (SELECT question, string_agg(line, ' ' ORDER BY k, claim_no) FILTER (k IS NOT NULL) AS told, arg_min(claim, claim_no) FILTER (claim_type = 'absent') AS absent FROM ln GROUP BY 1) SELECT a.question, coalesce(absent, told, '{V.NOTHING}') AS answer FROM asked a LEFT JOIN gr USING (question)""")
def _(t):
    return V.render(checked(t), "question")


CASE_PATTERN = "CASE " + " ".join(f"WHEN {any_sql(w)} THEN '{n}'" for n, w in V.PATTERN_WORDS) + " ELSE 'general' END"


@query("two_pass_early_exit", f"""WITH {CHECKED}, lo AS (SELECT question, lower(text) AS low FROM asked), pt AS (SELECT question, {CASE_PATTERN} AS pattern FROM lo), cn AS (SELECT question, count(*) AS claims, count(*) FILTER (status IN ('supported', 'partially_supported')) AS supported, count(*) FILTER (status NOT IN ('supported', 'partially_supported')) AS rejected FROM ck GROUP BY 1)
  SELECT question, claims, supported, rejected, pattern, rejected = 0 AND supported <= 10 AND (pattern IN ('simple_lookup', 'numerical', 'absent_info') OR pattern = 'conflict' AND supported <= 5) AS early FROM cn JOIN pt USING (question)""")
def _(t):
    return V.early_exit(checked(t), frames.questions(t), "question")


@query("claim_set_partition", f"WITH {CHECKED} SELECT claim_type, count(*) FILTER (status IN ('supported', 'partially_supported')) AS supported, count(*) FILTER (status = 'unsupported') AS rejected FROM ck GROUP BY 1")
def _(t):
    return checked(t).groupBy("claim_type").agg(F.count_if(F.col("status").isin("supported", "partially_supported")).alias("supported"), F.count_if(F.col("status") == "unsupported").alias("rejected"))


# ---- confidence: a claim per question; its reports of kind A support it, the others speak against it ------------------------

CONF = f"""{REPORTS}, cl AS (SELECT question, CASE WHEN q_no % 5 > 0 THEN q_no END AS subject, CASE WHEN q_no % 2 = 0 THEN q_no END AS object, CASE WHEN q_no % 3 = 0 THEN q_no END AS valid_from, (q_no % 10) / 10.0::DOUBLE AS verifier_judgment FROM names),
  eg AS (SELECT question, kind[1] = 'A' AS s, score, source, CASE kind[2] WHEN 'F' THEN 0.9 ELSE 0.5 END AS w FROM reports),
  ca AS (SELECT question, count(*) FILTER (s) AS s, count(*) FILTER (NOT s) AS c, avg(score * w) FILTER (s) AS q, count(DISTINCT source) FILTER (s) AS d, avg(score) FILTER (s) AS r FROM eg GROUP BY 1),
  cc AS (SELECT question, least(1, s / (s + c) * CASE WHEN subject IS NOT NULL AND object IS NOT NULL THEN 0.8 WHEN subject IS NOT NULL THEN 0.9 ELSE 1 END) AS evidence_coverage, coalesce(q, 0) AS source_quality, least(1, s / (s + c) + least(0.2, d * 0.05)) AS cross_source_agreement,
    CASE WHEN s = 0 THEN 0 WHEN valid_from IS NULL THEN 0.7 ELSE 1 END::DOUBLE AS temporal_relevance, least(1, coalesce(r, 0)) AS retrieval_rank, verifier_judgment FROM cl JOIN ca USING (question))"""
PARTS = ["evidence_coverage", "source_quality", "cross_source_agreement", "temporal_relevance", "retrieval_rank", "verifier_judgment"]


def components(t):
    c = frames.questions(t).select("question", F.when(F.col("q_no") % 5 > 0, F.col("q_no")).alias("subject"), F.when(F.col("q_no") % 2 == 0, F.col("q_no")).alias("object"), F.when(F.col("q_no") % 3 == 0, F.col("q_no")).alias("valid_from"), ((F.col("q_no") % 10) / 10.0).alias("verifier_judgment"))
    e = frames.reports(t).select("question", (F.substring("kind", 1, 1) == "A").alias("supports"), "score", "source", F.when(F.substring("kind", 2, 1) == "F", "pdf").otherwise("HTML").alias("source_type"))
    return V.confidence_components(c, e, "question")


@query("confidence_composite", f"WITH {CONF} SELECT question, {', '.join(f'round({p}, 6) AS {p}' for p in PARTS)}, round(({' + '.join(PARTS)}) / 6, 6) AS composite FROM cc")
def _(t):
    return components(t).select("question", *[F.round(p, 6).alias(p) for p in [*PARTS, "composite"]])


STATUS = "CASE WHEN evidence_coverage = 0 THEN 'unsupported' WHEN verifier_judgment >= 0.8 THEN 'supported' WHEN verifier_judgment < 0.2 THEN 'contradicted' ELSE 'partial' END"
RESULTS = f"{CONF}, rs AS (SELECT *, {STATUS} AS status FROM cc)"


def results(t):
    return components(t).withColumn("status", F.expr(STATUS)).withColumn("claim", F.col("question"))


@query("claim_gap_queries", f"""WITH {RESULTS} SELECT question, 'no_evidence' AS gap_type, 'Evidence for: ' || question AS suggested_query, 0.9::DOUBLE AS priority FROM rs WHERE status = 'unsupported' UNION ALL SELECT question, 'partial_coverage', 'Evidence for: ' || question, 0.7::DOUBLE FROM rs WHERE status = 'partial' AND evidence_coverage < 0.5
  UNION ALL SELECT question, 'source_quality', 'Authoritative sources for: ' || question, 0.6::DOUBLE FROM rs WHERE status = 'partial' AND source_quality < 0.5 UNION ALL SELECT question, 'temporal_mismatch', 'Recent evidence for: ' || question, 0.6::DOUBLE FROM rs WHERE status = 'partial' AND temporal_relevance < 0.5
  UNION ALL SELECT question, 'contradiction_resolution', 'Resolving contradictory evidence for: ' || question, 0.8::DOUBLE FROM rs WHERE status = 'contradicted'""")
def _(t):
    return V.claim_gaps(results(t), "question")


@query("verification_counts", f"WITH {RESULTS} SELECT valid, count(*) AS total, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'contradicted') AS contradicted, count(*) FILTER (status = 'unsupported') AS unsupported, count(*) FILTER (status = 'error') AS error FROM (SELECT *, temporal_relevance = 1 AS valid FROM rs) GROUP BY 1")
def _(t):
    return V.batch_counts(results(t).withColumn("valid", F.col("temporal_relevance") == 1), "valid")


@query("grounding_scores", f"WITH {REPORTS} SELECT question, max(score) AS best, round(avg(score), 6) AS mean, round(avg(score) FILTER (rank <= 3), 6) AS top3, avg(score) < 0.5 AS uncertain FROM reports GROUP BY 1")
def _(t):
    return V.grounding(frames.reports(t), "question", "rank").withColumns({"mean": F.round("mean", 6), "top3": F.round("top3", 6)})


GROUND = f"{REPORTS}, gr AS (SELECT question, count(*) AS n, max(score) AS best, avg(score) AS mean, avg(score) FILTER (rank <= 3) AS top3, stddev_samp(score) / nullif(avg(score), 0) AS cv FROM reports GROUP BY 1)"


def ground(t):
    g = V.grounding(frames.reports(t), "question", "rank")
    return g.join(frames.reports(t).groupBy("question").agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp("score") / F.nullif(F.avg("score"), F.lit(0.0))).alias("cv")), "question").join(frames.questions(t).select("question", "q_no"), "question")


@query("tier_adjustment", f"WITH {GROUND}, ti AS (SELECT question, CASE q_no % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'balanced' ELSE 'fast' END AS tier FROM names) SELECT question, tier, CASE WHEN tier = 'fast' OR n < 3 THEN tier WHEN top3 >= 0.75 THEN 'fast' WHEN top3 >= 0.6 AND tier = 'strong' THEN 'balanced' ELSE tier END AS adjusted FROM gr JOIN ti USING (question)")
def _(t):
    g = ground(t).withColumn("tier", F.when(F.col("q_no") % 3 == 0, "strong").when(F.col("q_no") % 3 == 1, "balanced").otherwise("fast"))
    return g.select("question", "tier", V.adjusted_tier(F.col("tier"), F.col("n"), F.col("top3")).alias("adjusted"))


@query("agent_activation", f"""WITH {GROUND}, rk AS (SELECT question, CASE q_no % 4 WHEN 0 THEN 'high' ELSE 'low' END AS risk FROM names), sk AS (SELECT *, n > 0 AND risk = 'low' AND best >= 0.8 AND NOT coalesce(cv > 0.9, false) AS skip FROM gr JOIN rk USING (question))
  SELECT question, skip, CASE WHEN skip THEN ['researcher', 'judge'] WHEN risk = 'high' OR coalesce(cv > 0.3, false) OR mean < 0.5 THEN ['researcher', 'verifier', 'skeptic', 'alternative_hypothesis', 'judge'] ELSE ['researcher', 'verifier', 'judge'] END AS roles FROM sk""")
def _(t):
    g = ground(t).withColumn("risk", F.when(F.col("q_no") % 4 == 0, "high").otherwise("low"))
    g = g.withColumn("skip", planning.skip_verification(F.col("n"), F.col("risk"), F.col("best"), F.col("cv"), 0.8, 0.9))
    return g.select("question", "skip", V.active_roles(F.col("n"), F.col("risk"), F.col("best"), F.col("mean"), F.col("cv"), F.col("skip")).alias("roles"))


@query("debate_disagreement", "SELECT user_id, max(value) FILTER (event_type = 'error') / 100 AS severity, max(value) FILTER (event_type = 'click') / 200 AS distinctiveness, count(*) FILTER (event_type = 'signup') AS contradicted, coalesce((max(value) FILTER (event_type = 'error') IS NOT NULL OR max(value) FILTER (event_type = 'click') IS NOT NULL) AND (coalesce(max(value) FILTER (event_type = 'error') / 100, 0) >= 0.3 OR coalesce(max(value) FILTER (event_type = 'click') / 200, 0) >= 0.3 OR count(*) FILTER (event_type = 'signup') > 0), false) AS disagree FROM events GROUP BY 1")
def _(t):
    at = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    g = t.events.groupBy("user_id").agg((at("error") / 100).alias("severity"), (at("click") / 200).alias("distinctiveness"), F.count_if(F.col("event_type") == "signup").alias("contradicted"))
    return g.select("*", V.disagreement(F.col("severity"), F.col("distinctiveness"), F.col("contradicted"), F.lit(0)).alias("disagree"))


# ---- answers: two cited sentences and one without; gold are the reports of kind F ---------------------------------------------

ANSWER = f"""{REPORTS}, answers AS (SELECT question, q_no, max(CASE WHEN rank = 1 THEN split_part(text, '. ', 1) END) || ' [1]. ' || max(CASE WHEN rank = 2 THEN split_part(text, '. ', 1) END) || CASE WHEN q_no % 4 = 0 THEN '' ELSE ' [2][9]' END || '. Nothing else was reported.' AS answer FROM reports GROUP BY question, q_no)"""
_ANSWER_SPARK = ANSWER.replace(REPORTS, frames.REPORTS)


def answers(t):
    return frames.frame(t, _ANSWER_SPARK, "answers")


@query("cited_result_build", f"""WITH {ANSWER}, bare AS (SELECT question, CASE WHEN q_no % 3 = 0 THEN regexp_replace(answer, '\\[[0-9]+\\]', '', 'g') ELSE answer END AS answer FROM answers), ids AS (SELECT question, list_filter(list_transform(regexp_extract_all(answer, '\\[(\\d{{1,6}})\\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 6) AS raw FROM bare),
  fin AS (SELECT question, len(raw) = 0 AS fallback, CASE WHEN len(raw) = 0 THEN [1, 2, 3] ELSE list_filter(raw, lambda x, i: list_position(raw, x) = i) END AS ids FROM ids) SELECT question, CAST(unnest(range(1, len(ids) + 1)) AS INTEGER) AS ref, CAST(unnest(ids) AS INTEGER) AS rank, fallback FROM fin""")
def _(t):
    a = answers(t).withColumn("answer", F.when(F.col("q_no") % 3 == 0, F.regexp_replace("answer", r"\[[0-9]+\]", "")).otherwise(F.col("answer")))
    return V.cited_evidence(a, frames.reports(t), "question", "rank")


_ITEMS = """cited AS (SELECT question, list_sort(list(rank)) AS cited, list(rank) FILTER (kind[2] = 'F') AS gold, list(rank) FILTER (kind = 'RO') AS distractors, CAST(max(year) FILTER (rank = 1) AS VARCHAR) AS y FROM reports GROUP BY 1), high AS (SELECT DISTINCT question FROM sig WHERE confidence = 'HIGH'),
  items AS (SELECT a.question, q_no, answer, cited, coalesce(gold, []) AS gold, coalesce(distractors, []) AS distractors, CASE WHEN q_no % 2 = 0 THEN [y] ELSE [] END AS gold_years, q_no % 3 = 0 AS expects, h.question IS NOT NULL AS detected, q_no % 4 = 1 AS adversarial FROM answers a JOIN cited USING (question) LEFT JOIN high h ON h.question = a.question),
  rf AS (SELECT *, list_filter(list_transform(regexp_extract_all(answer, '\\[\\s*(\\d+)\\s*\\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND len(cited)) AS refs FROM items),
  sc AS (SELECT question, q_no, CASE WHEN len(refs) = 0 THEN 0 ELSE len(list_filter(refs, lambda x: list_contains(gold, cited[x]))) / len(refs) END AS citation_correctness, len(gold) / len(cited) AS evidence_precision, CASE WHEN len(gold) > 0 THEN 1 END::DOUBLE AS recall, CASE WHEN expects THEN CAST(detected AS INTEGER) END::DOUBLE AS contradiction_recall,
    CASE WHEN len(gold_years) > 0 THEN CAST(contains(answer, gold_years[1]) AS INTEGER) END::DOUBLE AS temporal_accuracy, CASE WHEN adversarial THEN CAST(len(distractors) = 0 AS INTEGER) END::DOUBLE AS adversarial_robustness, NULL::DOUBLE AS vault_personalization_gain, CASE WHEN q_no % 2 = 0 THEN q_no END::DOUBLE AS reindex_cost, NULL::DOUBLE AS write_back_usefulness FROM rf)"""
ITEMS = f"{ANSWER}, {PAIRS}, {_ITEMS}"
SCORES = ["citation_correctness", "evidence_precision", "recall", "contradiction_recall", "temporal_accuracy", "adversarial_robustness", "vault_personalization_gain", "reindex_cost", "write_back_usefulness"]


def scored(t):
    r = frames.reports(t)
    picked = lambda cond: F.collect_list(F.when(cond, F.col("rank")))
    g = r.groupBy("question").agg(F.array_sort(F.collect_list("rank")).alias("cited"), picked(F.substring("kind", 2, 1) == "F").alias("gold"), picked(F.col("kind") == "RO").alias("distractors"), F.max(F.when(F.col("rank") == 1, F.col("year"))).cast("string").alias("y"))
    hard = conflicts.evidence_pairs(r, "question", "rank").filter("confidence = 'HIGH'").select("question").distinct().withColumn("detected", F.lit(True))
    i = answers(t).join(g, "question").join(hard, "question", "left").withColumns({
        "detected": F.coalesce("detected", F.lit(False)), "expects_contradiction": F.col("q_no") % 3 == 0, "gold_years": F.when(F.col("q_no") % 2 == 0, F.array("y")).otherwise(F.array().cast("array<string>")), "adversarial": F.col("q_no") % 4 == 1,
        "metadata": F.when(F.col("q_no") % 2 == 0, F.create_map(F.lit("reindex_duration_ms"), F.col("q_no").cast("string"))).otherwise(F.create_map().cast("map<string,string>")),
    })
    return evaluation.item_scores(i, "question").join(frames.questions(t).select("question", "q_no"), "question")


@query("benchmark_item_scores", f"WITH {ITEMS} SELECT question, {', '.join(f'round({s}, 6) AS {s}' for s in SCORES)} FROM sc")
def _(t):
    return scored(t).select("question", *[F.round(s, 6).alias(s) for s in SCORES])


LONG = " UNION ALL ".join(f"SELECT q_no % 4 AS class, '{s}' AS metric, {s} AS v FROM sc" for s in SCORES)


@query("benchmark_means_applicable", f"WITH {ITEMS}, lg AS ({LONG}) SELECT class, metric, round(avg(v), 6) AS value, count(v) AS applicable FROM lg GROUP BY 1, 2")
def _(t):
    return evaluation.applicable_means(scored(t).withColumn("class", F.col("q_no") % 4).drop("question", "q_no"), ["class"], SCORES)


@query("ablation_deltas", f"WITH {ITEMS}, lg AS ({LONG}), mv AS (SELECT 'variant_' || class AS variant, metric, avg(v) AS value FROM lg GROUP BY 1, 2) SELECT a.variant, a.metric, round(round(a.value, 6) - round(b.value, 6), 4) AS delta FROM mv a JOIN mv b ON a.metric = b.metric AND b.variant = 'variant_0'")
def _(t):
    m = evaluation.applicable_means(scored(t).withColumn("variant", F.concat(F.lit("variant_"), (F.col("q_no") % 4).cast("string"))).drop("question", "q_no"), ["variant"], SCORES)
    return evaluation.variant_deltas(m, "variant_0")


CASES = f"""{ANSWER}, {PAIRS}, sg AS (SELECT question, count(*) AS n FROM sig GROUP BY 1), cs AS (SELECT r.question, q_no % 4 AS class, CASE WHEN count(*) FILTER (kind[2] = 'F') > 0 THEN (count(*) FILTER (kind[2] = 'F' AND rank <= 4)) / (count(*) FILTER (kind[2] = 'F')) END AS recall, (count(*) FILTER (kind[2] = 'F' AND rank <= 4)) / 4 AS precision,
    CASE WHEN q_no % 5 > 0 THEN CAST(bool_or(contains(lower(text), 'superseded')) AS INTEGER) END::DOUBLE AS coverage, coalesce(max(sg.n), 0) AS signals, q_no % 3 = 0 AS conflict_expected, max(score) < 0.95 AS absent_trigger, q_no % 7 = 0 AS absent_expected FROM reports r LEFT JOIN sg ON sg.question = r.question GROUP BY r.question, q_no)"""


@query("end_to_end_report", f"""WITH {CASES}, k AS (SELECT *, conflict_expected AND signals > 0 AS tp, NOT conflict_expected AND signals > 0 AS fp, conflict_expected AND signals = 0 AS fn FROM cs)
  SELECT class, count(*) AS n, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(coverage), 4) AS coverage, round(CASE WHEN count(*) FILTER (tp OR fp) > 0 THEN (count(*) FILTER (tp)) / (count(*) FILTER (tp OR fp)) END, 4) AS contradiction_precision, round(CASE WHEN count(*) FILTER (tp OR fn) > 0 THEN (count(*) FILTER (tp)) / (count(*) FILTER (tp OR fn)) END, 4) AS contradiction_recall,
    round(CASE WHEN count(*) FILTER (absent_expected) > 0 THEN (count(*) FILTER (absent_expected AND absent_trigger)) / (count(*) FILTER (absent_expected)) END, 4) AS abstention, CAST(grouping(class) AS INTEGER) AS is_total FROM k GROUP BY ROLLUP (class)""")
def _(t):
    r = frames.reports(t)
    signals = conflicts.evidence_pairs(r, "question", "rank").groupBy("question").agg(F.count(F.lit(1)).alias("signals"))
    gold = F.substring("kind", 2, 1) == "F"
    g = r.groupBy("question", "q_no").agg(F.count_if(gold).alias("g"), F.count_if(gold & (F.col("rank") <= 4)).alias("h"), F.bool_or(F.contains(F.lower("text"), F.lit("superseded"))).alias("c"), F.max("score").alias("best")).join(signals, "question", "left")
    q = F.col("q_no")
    c = g.select(
        (q % 4).alias("class"), F.when(F.col("g") > 0, F.col("h") / F.col("g")).alias("recall"), (F.col("h") / 4).alias("precision"), F.when(q % 5 > 0, F.col("c").cast("int").cast("double")).alias("coverage"),
        F.coalesce("signals", F.lit(0)).alias("signals"), (q % 3 == 0).alias("conflict_expected"), (F.col("best") < 0.95).alias("absent_trigger"), (q % 7 == 0).alias("absent_expected"),
    )
    return evaluation.retrieval_report(c, "class")


TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query("claim_support_rate", f"""WITH {ANSWER}, se AS (SELECT question, unnest(string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM answers), sn AS (SELECT question, row_number() OVER () AS n, trim(s) AS s FROM se WHERE trim(s) <> ''),
  gd AS (SELECT question, rank, {TOKENS.format('text')} AS tk FROM reports WHERE kind[2] = 'F'), st AS (SELECT question, n, list_transform(regexp_extract_all(s, '\\[\\s*(\\d+)\\s*\\]', 1), lambda x: CAST(x AS INTEGER)) AS refs, {TOKENS.format('s')} AS tk FROM sn),
  ok AS (SELECT st.question, st.n, coalesce(bool_or(list_contains(refs, rank) OR len(st.tk) > 0 AND len(list_intersect(st.tk, gd.tk)) / len(st.tk) >= 0.5), false) AS ok FROM st LEFT JOIN gd ON gd.question = st.question GROUP BY ALL) SELECT question, count(*) AS sentences, count(*) FILTER (ok) AS grounded, round((count(*) FILTER (ok)) / count(*), 6) AS rate FROM ok GROUP BY 1""")
def _(t):
    return evaluation.grounded_sentences(answers(t), frames.reports(t).withColumn("gold", F.substring("kind", 2, 1) == "F"), "question", "rank").withColumn("rate", F.round("rate", 6))


# gold facts: what the answer should hold, some of it denied or absent
NEG = X.NEGATIONS.replace("'", "''")
KT = lambda c: terms_sql(c, 1, X.ANSWER_STOP, "a-z")
FACTS = f"""{REPORTS}, fx AS (SELECT question, q_no, max(CASE WHEN rank = 1 THEN split_part(text, '. ', 1) END) || CASE WHEN q_no % 3 = 0 THEN '. The Depot never closed.' ELSE '. The Depot closed.' END AS answer, CAST(max(CASE WHEN rank = 1 THEN year END) AS VARCHAR(4)) AS y FROM reports GROUP BY question, q_no),
  facts AS (SELECT question, answer, y AS fact FROM fx UNION ALL SELECT question, answer, 'closed depot' FROM fx UNION ALL SELECT question, answer, 'quite another matter' FROM fx)"""


@query("gold_fact_check", f"""WITH {FACTS}, k AS (SELECT *, lower(answer) AS a, lower(fact) AS f, {KT('answer')} AS ta, {KT('fact')} AS tf FROM facts), m AS (SELECT *, regexp_matches(a, '\\b(?:{NEG})\\b') AS neg, regexp_extract(a, '^(.*?\\b(?:{NEG})\\b)', 1) AS first FROM k)
  SELECT question, fact, CASE WHEN list_has_any(tf, ta) AND neg OR instr(a, f) > 0 AND first <> '' AND instr(a, f) - 1 - length(first) < 30 THEN 'negated' WHEN contains(a, f) THEN 'found' WHEN len(tf) > 0 AND len(list_intersect(tf, ta)) / len(tf) >= 0.7 THEN 'found' ELSE 'missing' END AS status FROM m""")
def _(t):
    f = frames.frame(t, FACTS.replace(REPORTS, frames.REPORTS), "facts")
    return V.gold_facts(f.select("question", "answer").distinct(), f.select("question", "fact"), ["question"], "answer", "fact")


@query("question_answer_relevance", f"WITH {ANSWER}, k AS (SELECT question, {KT('q.text')} AS q, {KT('answer')} AS a FROM answers JOIN asked q USING (question)) SELECT question, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, a)) / len(q) END, 6) AS relevance FROM k")
def _(t):
    j = answers(t).join(frames.questions(t).select("question", "text"), "question")
    q = X.key_terms(F.col("text"))
    return j.select("question", F.round(F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, X.key_terms(F.col("answer")))) / F.size(q)), 6).alias("relevance"))


@query("claim_support_classes", f"""WITH {REPORTS}, c AS (SELECT x.question, x.rank, split_part(x.text, '. ', 1) AS claim, CASE WHEN x.rank % 3 = 0 THEN [x.rank, 8] WHEN x.rank % 5 = 0 THEN [] ELSE [x.rank] END AS ids, y.text AS body FROM reports x JOIN reports y ON x.question = y.question AND y.rank = CASE WHEN x.rank = 4 THEN 5 ELSE x.rank END),
  n AS (SELECT *, list_transform(list_filter(regexp_extract_all(claim, '[0-9]+(?: million)?'), lambda v: true), lambda v: CAST(regexp_extract(v, '[0-9]+') AS BIGINT)) AS cn, {KT('claim')} AS tc, {KT('body')} AS tb FROM c)
  SELECT question, rank, CASE WHEN len(ids) = 0 THEN 'no_citation' WHEN len(ids) > 1 THEN 'invalid_citation' ELSE 'cited' END AS citation, round(len(list_intersect(tc, tb)) / greatest(len(tc), 1), 6) AS overlap FROM n""")
def _(t):
    r = frames.reports(t)
    body = r.select("question", F.col("rank").alias("b"), F.col("text").alias("body"))
    c = r.withColumn("b", F.when(F.col("rank") == 4, 5).otherwise(F.col("rank"))).join(body, ["question", "b"]).withColumn("claim", F.split_part("text", F.lit(". "), F.lit(1)))
    none = F.array().cast("array<int>")
    c = c.withColumn("ids", F.when(F.col("rank") % 3 == 0, F.array("rank", F.lit(8))).when(F.col("rank") % 5 == 0, none).otherwise(F.array("rank")))
    status = V.claim_support(F.col("claim"), F.col("ids"), F.array("body"), F.lit(6))
    terms = X.key_terms(F.col("claim"))
    share = F.size(F.array_intersect(terms, X.key_terms(F.col("body")))) / F.greatest(F.size(terms), F.lit(1))
    return c.select("question", "rank", F.when(status.isin("no_citation", "invalid_citation"), status).otherwise("cited").alias("citation"), F.round(share, 6).alias("overlap"))


# ---- fusion with weights by the question's pattern ------------------------------------------------------------------------------

WEIGHTS = [("exact_term", 0.7, 0.3), ("conceptual", 0.3, 0.7), ("long_report", 0.4, 0.6), ("entity_relationship", 0.5, 0.5), ("comparative", 0.4, 0.6), ("causal", 0.3, 0.7)]


@query("pattern_adaptive_fusion", f"""WITH {CH}, lw AS (SELECT item_id, text, lower(trim(text)) AS low FROM benchmark), bp AS (SELECT item_id, {PATTERN} AS pattern FROM lw), wt(pattern, wb, wv) AS (VALUES {', '.join(f"('{p}', {b}::DOUBLE, {v}::DOUBLE)" for p, b, v in WEIGHTS)}),
  sc AS (SELECT ch.item_id, doc_id, bp.pattern, round(coalesce(wb, 0.5) * CASE WHEN mb > 0 THEN coalesce(bm25, 0) / mb ELSE 0 END + coalesce(wv, 0.5) * coalesce(cosine, 0), 8) AS fused FROM ch JOIN bp ON bp.item_id = ch.item_id LEFT JOIN wt ON wt.pattern = bp.pattern)
  SELECT item_id, doc_id, pattern, fused, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS r FROM sc) WHERE r <= 10""")
def _(t):
    p = t.benchmark.select("item_id", planning.question_pattern(F.col("text")).alias("pattern"))
    w = t.spark.createDataFrame(WEIGHTS, "pattern string, w_b double, w_v double")
    return fusion.fuse_by_pattern(channel_frame(t), p, w, "item_id", "doc_id", 10)


