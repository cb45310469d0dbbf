"""Queries of evidence needs, their coverage and recovery, and of contradictions, over questions and reports about parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlight.functions import text as X
from weftlight.operators import conflicts, extraction, lexical, needs, planning
from weftlight.plans import frames
from weftlight.plans.evidence_queries import MASK, PATTERN, any_sql, sql_list, terms_sql
from weftlight.plans.registry import query
from weftlight.plans.retrieval_queries import TOK, bm25_sql

ASKED, REPORTS = frames.plain(frames.QUESTIONS), frames.plain(frames.REPORTS)
STOP = sql_list(needs.TOPIC_STOP)


def topic_sql(x):
    return f"array_to_string(list_filter(list_transform(list_filter(string_split_regex({x}, '\\s+'), lambda v: v <> ''), lambda v: lower(regexp_replace(v, '[^a-zA-Z0-9]', '', 'g'))), lambda v: length(v) > 2 AND NOT list_contains({STOP}, v))[1:6], ' ')"


def analysed_sql(source, key):
    """CTE qq: key, text, e (entities), p (topic) of a source with key and text."""
    return f"""base AS (SELECT {key}, text, regexp_extract_all({MASK.format('text')}, '\\b([A-Z][a-zA-Z]*(?:\\s+[A-Z][a-zA-Z]*)*)\\b', 1) AS raw, regexp_extract_all({MASK.format('text')}, '(?:^|[.!?]\\s+)(\\w+)', 1) AS starts FROM {source}),
  qq AS (SELECT {key}, text, list_filter(raw, lambda x, i: list_position(raw, x) = i AND NOT list_contains(starts, x) AND NOT list_contains({STOP}, lower(x)))[1:5] AS e, {topic_sql('text')} AS p FROM base)"""


def topics_sql(source, key):
    """CTE td: key, t (the topics of text)."""
    cut = "text"
    for c in needs.CONNECTORS:
        cut = f"regexp_replace({cut}, '{c}', {'chr(92) || ' + chr(39) + '1' + chr(39) + ' || chr(1)' if c.startswith(('(' + chr(92) + '.', '(' + chr(92) + 'w')) else 'chr(1)'}, 'gi')"
    trim = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    side = lambda i: f"regexp_extract_all(text, '(?i){needs.COMPOUND}', {i})"
    return f"""pa AS (SELECT {key}, list_filter(list_transform(string_split({cut}, chr(1)), lambda x: regexp_replace({trim('x')}, '^\\.+|\\.+$', '', 'g')), lambda x: length(x) > 10) AS parts FROM {source}),
  pe AS (SELECT {key}, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM pa),
  pt AS (SELECT {key}, n, {topic_sql('part')} AS tp, {trim("regexp_replace(part, '[^a-zA-Z0-9\\s]', '', 'g')")} AS bare, len(list_filter(string_split_regex(part, '\\s+'), lambda v: v <> '')) AS nw FROM pe),
  pf AS (SELECT {key}, list(t ORDER BY n) FILTER (t IS NOT NULL) AS f FROM (SELECT {key}, n, CASE WHEN length(tp) > 3 THEN CASE WHEN len(string_split(tp, ' ')) < 2 AND nw > 2 THEN nullif(bare, '') ELSE tp END END AS t FROM pt) GROUP BY ALL),
  sd AS (SELECT {key}, text, {side(1)} AS l, {side(2)} AS r FROM {source}),
  td0 AS (SELECT {key}, text, coalesce(f, []) AS f, len(l) AS ns, flatten(list_transform(l, lambda a, i: list_filter([{trim('a')}, {trim('r[i]')}], lambda x: length(x) > 3))) AS s FROM sd LEFT JOIN pf USING ({key})),
  td1 AS (SELECT {key}, text, CASE WHEN len(f) <= 1 AND ns > 0 THEN s ELSE f END AS t FROM td0), td AS (SELECT {key}, CASE WHEN len(t) > 0 THEN t ELSE [{topic_sql('text')}] END AS t FROM td1)"""


TURNS = f"talk AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS k, {MASK.format('text')} AS text FROM conversations)"


def talk(t):
    return t.conversations.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("k"), X.masked_ascii(F.col("text")).alias("text"))


@query("decompose_topics", f"WITH {TURNS}, {topics_sql('talk', 'k')} SELECT k, unnest(t) AS topic, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS topic_no FROM td")
def _(t):
    return talk(t).select("k", F.posexplode(needs.topics(F.col("text"))).alias("topic_no", "topic"))


@query("question_entities_topic", f"WITH {TURNS}, {analysed_sql('talk', 'k')} SELECT k, e AS entities, p AS topic FROM qq")
def _(t):
    return talk(t).select("k", needs.entities(F.col("text")).alias("entities"), needs.topic(F.col("text")).alias("topic"))


PLAN = f"""{ASKED}, lowered AS (SELECT question, text, lower(trim(text)) AS low FROM asked), pats AS (SELECT question, {PATTERN} AS pattern FROM lowered), {analysed_sql('asked', 'question')}, {topics_sql('asked', 'question')},
  pl AS (SELECT * FROM qq JOIN pats USING (question) JOIN td USING (question)),
  nd AS (
    SELECT question, pattern, 0 AS kind, 0 AS i, 0 AS j, 'primary' AS claim_type, 'high' AS priority, p AS topic, e AS entities, text AS search_query, false AS opposing FROM pl WHERE pattern IN ('conflict', 'multi_hop')
    UNION ALL SELECT question, pattern, 1, 0, 0, 'supporting', 'high', p, e, array_to_string(e, ' ') || ' latest data figures', false FROM pl WHERE pattern = 'conflict' AND len(e) > 0 AND NOT regexp_matches(text, '\\b20\\d{{2}}\\b')
    UNION ALL SELECT question, pattern, 2, 0, 0, 'contradictory', 'high', p, e, array_to_string(e, ' ') || ' ' || p || ' discrepancy alternative source', true FROM pl WHERE pattern = 'conflict' AND len(e) > 0
    UNION ALL SELECT question, pattern, 3, 0, 0, 'caveat', 'medium', p, e, array_to_string(e, ' ') || ' ' || p || ' caveat exception limitation note', false FROM pl WHERE pattern = 'conflict' AND len(e) > 0
    UNION ALL SELECT question, pattern, 0, i, 0, 'primary', CASE WHEN i = 1 THEN 'high' ELSE 'medium' END, t[i], e, CASE WHEN len(e) > 0 THEN array_to_string(e[1:2], ' ') || ' ' ELSE '' END || t[i], false FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM pl WHERE pattern = 'complex_research')
    UNION ALL SELECT question, pattern, 4, i, j, 'contextual', 'medium', e[i] || ' - ' || e[j], [e[i], e[j]], e[i] || ' ' || e[j] || ' ' || p, false FROM (SELECT *, unnest(range(i + 1, len(e) + 1)) AS j FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM pl WHERE pattern = 'multi_hop'))
    UNION ALL SELECT question, pattern, 5, i, 0, 'supporting', 'medium', e[i], [e[i]], e[i] || ' ' || p, false FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM pl WHERE pattern = 'multi_hop')),
  plan AS (SELECT question, pattern, CAST(row_number() OVER (PARTITION BY question ORDER BY kind, i, j) - 1 AS INTEGER) AS need_no, claim_type, priority, topic, entities, search_query, opposing FROM nd)"""


def planned(t):
    return needs.plan(frames.questions(t).withColumn("pattern", planning.question_pattern(F.col("text"))), "question")


@query("plan_needs", f"WITH {PLAN} SELECT * FROM plan")
def _(t):
    return planned(t)


for _pattern, _name in (("conflict", "plan_conflict"), ("complex_research", "plan_complex_research"), ("multi_hop", "plan_needs_multi_hop")):
    query(_name, f"WITH {PLAN} SELECT question, need_no, claim_type, priority, topic, search_query FROM plan WHERE pattern = '{_pattern}'")(lambda t, p=_pattern: planned(t).filter(F.col("pattern") == p).select("question", "need_no", "claim_type", "priority", "topic", "search_query"))


@query("plan_dispatch", f"WITH {PLAN} SELECT question, pattern, pattern IN ('conflict', 'complex_research', 'multi_hop') AS is_planned, (SELECT count(*) FROM plan WHERE plan.question = pats.question) AS n_needs FROM pats")
def _(t):
    p = frames.questions(t).select("question", planning.question_pattern(F.col("text")).alias("pattern"))
    n = planned(t).groupBy("question").agg(F.count(F.lit(1)).alias("n"))
    return p.join(n, "question", "left").select("question", "pattern", F.col("pattern").isin(needs.PLANNED).alias("is_planned"), F.coalesce("n", F.lit(0)).alias("n_needs"))


# evidence of a question: its first three reports; the others are what a recovery can find
SAID = "len(list_filter(string_split(lower(topic), ' '), lambda w: length(w) > 3 AND contains(low, w))) > 0"
NAMED = "len(list_filter(entities, lambda x: contains(low, lower(x)))) > 0"
COVERAGE = f"""hits AS (SELECT n.question, need_no, bool_or(CASE claim_type WHEN 'caveat' THEN regexp_matches(r.text, '(?i){needs.DISCLAIMER}') WHEN 'primary' THEN {SAID} AND {NAMED} AND regexp_matches(r.text, '{needs.SPECIFIC}')
    WHEN 'contradictory' THEN regexp_matches(r.text, '(?i){needs.CONFLICT_WORDS}') AND {SAID} ELSE {SAID} OR {NAMED} END) AS met FROM plan n JOIN (SELECT question, text, lower(text) AS low FROM reports WHERE rank <= 3) r ON n.question = r.question GROUP BY ALL),
  cov AS (SELECT plan.*, coalesce(met, false) AS satisfied FROM plan LEFT JOIN hits USING (question, need_no)),
  cp AS (SELECT question, pattern, count(*) AS needs, count(*) FILTER (satisfied) AS satisfied, min(need_no) FILTER (NOT satisfied) AS first_unmet, coalesce(list(claim_type) FILTER (NOT satisfied), []) AS u FROM cov GROUP BY ALL),
  plans AS (SELECT question, pattern, needs, satisfied, satisfied / needs AS ratio, first_unmet, CASE WHEN len(u) = 0 THEN 'none' WHEN pattern = 'conflict' THEN CASE WHEN list_contains(u, 'caveat') THEN 'disclaimer' WHEN list_contains(u, 'contradictory') THEN 'related_claim' ELSE 'parent_context' END
    WHEN pattern = 'multi_hop' THEN 'bridge' WHEN pattern = 'complex_research' THEN 'section_expansion' ELSE 'parent_context' END AS recovery FROM cp)"""
# the reports' frame begins with the questions' frame, which the plan has already
ALL = f"{PLAN}, {REPORTS[len(ASKED) + 1:].strip()}, {COVERAGE}"


def evidence(t):
    return frames.reports(t).filter("rank <= 3")


def covered(t):
    return needs.coverage(planned(t), evidence(t), "question")


@query("need_satisfaction", f"WITH {ALL} SELECT question, need_no, claim_type, satisfied FROM cov")
def _(t):
    return covered(t).select("question", "need_no", "claim_type", "satisfied")


@query("coverage_recovery_type", f"WITH {ALL} SELECT question, pattern, needs, satisfied, round(ratio, 6) AS ratio, first_unmet, recovery FROM plans")
def _(t):
    return needs.coverage_by_plan(covered(t), "question").withColumn("ratio", F.round("ratio", 6))


BRIDGES = f"""{ALL}, tx AS (SELECT question, string_agg(text, ' ' ORDER BY rank) AS x FROM reports WHERE rank <= 3 GROUP BY 1), nn AS (SELECT question, regexp_extract_all(x, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1) AS raw FROM tx),
  br AS (SELECT question, need_no, list_filter(raw, lambda v, i: list_position(raw, v) = i AND NOT list_contains(list_transform(entities, lambda z: lower(z)), lower(v)))[1:3] AS bridges FROM plan JOIN nn USING (question))"""


@query("bridge_entities", f"WITH {BRIDGES} SELECT * FROM br")
def _(t):
    return needs.bridge_entities(planned(t), evidence(t), "question", "rank")


SEARCH = f"""{BRIDGES}, un AS (SELECT c.*, recovery, first_unmet FROM cov c JOIN plans p ON c.question = p.question WHERE NOT c.satisfied),
  se AS (SELECT question, recovery, i AS a, 0 AS b, topic || CASE recovery WHEN 'disclaimer' THEN {sql_list(needs.DISCLAIMER_SEARCHES)} ELSE {sql_list(needs.CONFLICT_SEARCHES)} END[i + 1] AS search_query FROM (SELECT *, unnest([0, 1]) AS i FROM un WHERE need_no = first_unmet AND recovery IN ('disclaimer', 'related_claim'))
    UNION ALL SELECT question, recovery, i - 1, need_no, bridges[i] || ' ' || topic FROM (SELECT *, unnest(range(1, len(bridges) + 1)) AS i FROM un JOIN br USING (question, need_no) WHERE recovery = 'bridge')
    UNION ALL SELECT r.question, recovery, rank, 0, substring(r.text, 1, 100) FROM reports r JOIN plans USING (question) WHERE rank <= 3 AND score > 0.5 AND recovery = 'section_expansion'),
  calls AS (SELECT question, recovery, call_no, search_query FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY a, b) AS INTEGER) AS call_no FROM se) WHERE call_no <= 2)"""


def searches(t):
    return t.kept("searches", lambda: needs.recovery_searches(t.kept("covered", lambda: covered(t)), evidence(t), "question", "rank"))


@query("recovery_searches", f"WITH {SEARCH} SELECT * FROM calls")
def _(t):
    return searches(t)


@query("recovered_evidence", f"""WITH {SEARCH}, asks AS (SELECT question || '|' || call_no AS ask, question, call_no, recovery, search_query AS text FROM calls), {bm25_sql('reports', 'chunk_id', 'asks', 'ask', 5)},
  fresh AS (SELECT a.question, a.call_no, a.recovery, l.rank, l.chunk_id, r.text FROM lex5 l JOIN asks a USING (ask) JOIN reports r ON r.chunk_id = l.chunk_id WHERE NOT EXISTS (SELECT 1 FROM reports x WHERE x.question = a.question AND x.rank <= 3 AND x.chunk_id = l.chunk_id)),
  keep AS (SELECT * FROM fresh WHERE recovery <> 'disclaimer' UNION ALL SELECT * FROM (SELECT * FROM fresh WHERE recovery = 'disclaimer' AND regexp_matches(text, '(?i){needs.DISCLAIMER}')) QUALIFY row_number() OVER (PARTITION BY question, call_no ORDER BY rank) = 1),
  once AS (SELECT question, chunk_id, min(call_no * 100 + rank) AS o FROM keep GROUP BY ALL) SELECT question, chunk_id, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY o) AS INTEGER) AS position FROM once) WHERE position <= 6""")
def _(t):
    s = searches(t).withColumn("ask", F.concat_ws("|", "question", F.col("call_no").cast("string")))
    r = frames.reports(t)
    hits = lexical.top_k(lexical.bm25_scores(r.select("chunk_id", "text"), ["chunk_id"], s.select("ask", F.col("search_query").alias("text")), "ask"), ["ask"], 5, ["chunk_id"])
    hits = hits.join(s.select("ask", "question", "call_no"), "ask").join(r.select("chunk_id", "text"), "chunk_id").select("question", "call_no", "rank", "chunk_id", "text")
    return needs.recovered(s, hits, evidence(t), "question", "chunk_id")


VERIFIED = f"""{ALL}, vm AS (SELECT n.*, r.text IS NOT NULL AS any_, low, contains(low, lower(topic)) AS said, len(list_filter(entities, lambda x: length(x) > 2 AND contains(low, lower(x)))) > 0 AS named FROM plan n LEFT JOIN (SELECT question, text, lower(text) AS low FROM reports WHERE rank <= 3) r ON n.question = r.question),
  vy AS (SELECT question, need_no, any_, said OR named AS hop, CASE claim_type WHEN 'primary' THEN said AND named WHEN 'contradictory' THEN {any_sql(needs.CONFLICT_INDICATORS)} WHEN 'supporting' THEN said OR named WHEN 'caveat' THEN {any_sql(needs.CAVEAT_INDICATORS)} ELSE said END AS yes,
    CASE WHEN claim_type = 'primary' THEN said OR named WHEN claim_type IN ('contradictory', 'caveat') THEN said ELSE false END AS half FROM vm),
  vf AS (SELECT question, need_no, count(*) FILTER (any_) AS n, count(*) FILTER (yes) AS supporting, count(*) FILTER (NOT yes AND half) AS partial, coalesce(bool_or(hop), false) AS hop_covered FROM vy GROUP BY ALL),
  vn AS (SELECT *, CASE WHEN n = 0 THEN 'no_evidence_exists' WHEN supporting > 0 THEN 'covered' WHEN partial > 0 THEN 'partially_covered' ELSE 'not_covered' END AS status FROM vf)"""


def verified(t):
    return needs.verified_needs(planned(t), evidence(t), "question")


@query("need_verification", f"WITH {VERIFIED} SELECT question, need_no, status, CASE status WHEN 'covered' THEN 1.0 WHEN 'partially_covered' THEN 0.5 ELSE 0.0 END::DOUBLE AS score, supporting, partial, hop_covered FROM vn")
def _(t):
    return verified(t)


@query("hop_chain_verification", f"WITH {VERIFIED}, ch AS (SELECT question, count(*) AS hops, count(*) FILTER (hop_covered) AS covered, min(need_no) FILTER (NOT hop_covered) AS w FROM vn JOIN pats USING (question) WHERE pattern = 'multi_hop' GROUP BY 1) SELECT question, hops, covered, CASE WHEN covered = hops THEN 'covered' WHEN covered > 0 THEN 'partially_covered' ELSE 'not_covered' END AS status, coalesce(w, -1) AS weakest FROM ch")
def _(t):
    return needs.verified_chains(verified(t).join(planned(t).filter("pattern = 'multi_hop'").select("question", "need_no"), ["question", "need_no"], "left_semi"), "question")


@query("coverage_selection", f"""WITH {REPORTS}, h AS (SELECT question, chunk_id, score, source % 5 AS source, rank % 3 AS need, rank % 3 = 0 AS high, kind = 'AF' AS shared FROM reports),
  r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk_id) AS rank, row_number() OVER (PARTITION BY question, need ORDER BY score DESC, chunk_id) AS rn, row_number() OVER (PARTITION BY question, source ORDER BY score DESC, chunk_id) AS rs FROM h)
  SELECT question, chunk_id, CAST(rank AS INTEGER) AS rank, round(score * CASE WHEN rn = 1 THEN 1.3 ELSE 1 END * CASE WHEN high THEN 1.2 ELSE 1 END * CASE WHEN shared THEN 1.15 ELSE 1 END * CASE WHEN rs > 3 THEN 0.7 ELSE 1 END, 6) AS selection_score FROM r WHERE rank <= 4""")
def _(t):
    h = frames.reports(t).select("question", "chunk_id", "score", (F.col("source") % 5).alias("source"), (F.col("rank") % 3).alias("need"), (F.col("rank") % 3 == 0).alias("high"), (F.col("kind") == "AF").alias("shared"))
    return needs.coverage_selection(h, "question", "chunk_id", 4).select("question", "chunk_id", "rank", F.round("selection_score", 6).alias("selection_score"))


# ---- gaps: subquestions are three angles, what was issued is the question itself --------------------------------------------

def gap_state(t):
    q, r = frames.questions(t), frames.reports(t)
    found = r.groupBy("question").agg(F.count_if(F.col("score") > 0.9).alias("found"), F.max(F.when(F.col("rank") > 3, F.col("score"))).alias("best"))
    hard = conflicts.evidence_pairs(r, "question", "rank").filter("confidence = 'HIGH'").groupBy("question").agg(F.count(F.lit(1)).alias("unresolved"))
    s = q.join(found, "question").join(hard, "question", "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(0)))
    angles = F.array(F.concat("title", F.lit(" revenue")), F.lit("weather of the northern depot"), F.lit("staff turnover"))
    return s.select("question", F.col("text").alias("query"), F.when(F.col("q_no") % 2 == 1, F.concat("title", F.lit(" objective"))).alias("objective"), "found", "best", angles.alias("subquestions"), F.array("text").alias("issued"), "unresolved")


METRIC = sql_list(sorted(X.METRICS))
_UNIT = "(billion|million|thousand|%|percent)?"
VALUES = "list_concat(" + ", ".join(rf"list_transform(regexp_extract_all(low, '(?i)(\b{m}\b[\s:]*(?:of|was|is|are|reached|totaled)?[\s:=$-]{{0,15}}\$?[\d,]+\.?\d*\s*{_UNIT})', 1), lambda x: {{'metric': '{m}', 'raw': x}})" for m in sorted(X.METRICS)) + ")"
VALUE_ROWS = rf"""vr AS (SELECT question, n, m.metric AS metric, TRY_CAST(replace(regexp_extract(m.raw, '(?i)\$?([\d,]*\d[\d,]*\.?\d*)\s*{_UNIT}$', 1), ',', '') AS DOUBLE) AS value, lower(regexp_extract(m.raw, '(?i){_UNIT}$', 1)) AS unit FROM (SELECT question, n, unnest({VALUES}) AS m FROM ch)),
  vs AS (SELECT question, n, metric, list(DISTINCT value * CASE unit WHEN 'million' THEN 0.001 WHEN 'thousand' THEN 0.000001 ELSE 1 END) AS vs FROM vr WHERE value > 0 AND NOT (unit = '' AND value BETWEEN 2000 AND 2099) GROUP BY ALL)"""
_OPP = lambda side: f"list_filter(range(0, {len(conflicts.OPPOSITES)}), lambda k: contains(low, {sql_list([p[side] for p in conflicts.OPPOSITES])}[k + 1]))"
PAIRS = rf"""ch AS (SELECT question, rank AS n, text, lower(text) AS low FROM reports),
  ft AS (SELECT question, n, list_distinct(list_transform(regexp_extract_all(text, '\b(20[0-9]{{2}})\b', 1), lambda x: CAST(x AS INTEGER))) AS y, list_filter(list_distinct(list_transform(regexp_extract_all(text, '\b([A-Z][a-z]{{2,}})\b', 1), lambda x: lower(x))), lambda x: NOT list_contains({sql_list(conflicts.NO_NAMES)}, x)) AS e,
    list_intersect(regexp_extract_all(low, '[\p{{L}}\p{{N}}_]{{4,}}'), {METRIC}) AS m, {terms_sql('text', 4, X.RELEVANCE_STOP)} AS w, {_OPP(0)} AS a, {_OPP(1)} AS b FROM ch), {VALUE_ROWS},
  pp AS (SELECT i.question, i.n AS i, j.n AS j, i.y AS yi, j.y AS yj, list_sort(list_intersect(i.e, j.e)) AS names, list_sort(list_intersect(i.m, j.m)) AS metrics, list_has_any(i.a, j.b) OR list_has_any(i.b, j.a) AS opposed, len(list_intersect(i.w, j.w)) AS shared FROM ft i JOIN ft j ON i.question = j.question AND i.n < j.n),
  ap AS (SELECT DISTINCT p.question, p.i, p.j FROM pp p JOIN vs x ON x.question = p.question AND x.n = p.i JOIN vs z ON z.question = p.question AND z.n = p.j AND z.metric = x.metric WHERE list_contains(p.metrics, x.metric) AND NOT list_has_any(x.vs, z.vs)),
  ps AS (SELECT pp.*, CASE WHEN opposed THEN 1.0 WHEN ap.i IS NOT NULL THEN 0.8 END::DOUBLE AS severity, list_has_any(yi, yj) AS same_time FROM pp LEFT JOIN ap ON ap.question = pp.question AND ap.i = pp.i AND ap.j = pp.j WHERE len(names) > 0 AND shared >= 3),
  sig AS (SELECT question, i, j, severity, names[1:3] AS names, metrics[1:3] AS metrics,
    CASE WHEN len(yi) > 0 AND len(yj) > 0 AND NOT same_time OR (len(yi) > 0) <> (len(yj) > 0) AND len(metrics) > 0 THEN 'DIFFERENT_TIMEFRAME' WHEN same_time AND len(metrics) > 0 THEN 'GENUINE_CONTRADICTION' WHEN len(metrics) > 0 THEN 'POSSIBLE_CONTRADICTION' ELSE 'IRRELEVANT_DIFFERENCE' END AS conflict_type,
    CASE WHEN (same_time OR len(yi) = 0 AND len(yj) = 0) AND len(metrics) > 0 AND severity >= 0.8 THEN 'HIGH' WHEN len(metrics) > 0 AND severity >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM ps WHERE severity IS NOT NULL)"""


@query("evidence_conflicts", f"WITH {REPORTS}, {PAIRS} SELECT question, i, j, severity, conflict_type, confidence, names, metrics FROM sig")
def _(t):
    return conflicts.evidence_pairs(frames.reports(t), "question", "rank")


@query("query_aware_conflicts", f"""WITH {REPORTS}, {PAIRS}, qw AS (SELECT question, lower(text) AS low, list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{4,}}')), lambda x: NOT list_contains({sql_list(conflicts.QUESTION_WORDS)}, x)) AS w FROM asked),
  qm AS (SELECT question, w, list_intersect(w, {METRIC}) AS m, {any_sql(conflicts.CONFLICT_INTENT)} AS c, {any_sql(conflicts.HISTORY_INTENT)} AS h, list_filter(w, lambda x: NOT list_contains({METRIC}, x)) AS o FROM qw)
  SELECT question, i, j, severity, conflict_type, confidence, names, metrics FROM sig JOIN qm USING (question) WHERE (conflict_type <> 'DIFFERENT_TIMEFRAME' OR h OR list_has_any(metrics, m)) AND (confidence <> 'LOW' OR c) AND CASE WHEN len(m) > 0 THEN list_has_any(metrics, m) ELSE c OR h END AND (len(o) = 0 OR list_has_any(names, o) OR list_has_any(metrics, m))""")
def _(t):
    return conflicts.relevant_conflicts(conflicts.evidence_pairs(frames.reports(t), "question", "rank"), frames.questions(t), "question")


GAPS = rf"""{REPORTS}, {PAIRS}, fo AS (SELECT question, count(*) FILTER (score > 0.9) AS found, max(score) FILTER (rank > 3) AS best FROM reports GROUP BY 1), hd AS (SELECT question, count(*) AS unresolved FROM sig WHERE confidence = 'HIGH' GROUP BY 1),
  st AS (SELECT a.question, text AS query, CASE WHEN q_no % 2 = 1 THEN title || ' objective' END AS objective, found, best, [title || ' revenue', 'weather of the northern depot', 'staff turnover'] AS subs, {terms_sql('text', 3, X.QUESTION_STOP, 'a-z0-9_')} AS issued, coalesce(unresolved, 0) AS unresolved FROM asked a JOIN fo USING (question) LEFT JOIN hd USING (question)),
  sq AS (SELECT question, query, unnest(subs) AS s, issued FROM st), ms AS (SELECT question, s FROM sq WHERE NOT list_has_any({terms_sql('s', 3, X.QUESTION_STOP, 'a-z0-9_')}, issued)), mc AS (SELECT question, count(*) AS lost FROM ms GROUP BY 1),
  gp AS (SELECT question, 'no_evidence' AS gap_type, query AS suggested_query, 0.9::DOUBLE AS priority FROM st WHERE found = 0 UNION ALL SELECT question, 'missing_evidence', s, 0.8::DOUBLE FROM ms
    UNION ALL SELECT question, 'low_coverage', coalesce(objective, query), 0.7::DOUBLE FROM st LEFT JOIN mc USING (question) WHERE (3 - coalesce(lost, 0)) / 3 < 0.5 UNION ALL SELECT question, 'evidence_quality', query || ' definition and supporting evidence', 0.6::DOUBLE FROM st WHERE found > 0 AND best < 0.3
    UNION ALL SELECT question, 'contradiction_unresolved', query || ' - resolution of conflicting evidence, authoritative sources', 0.85::DOUBLE FROM st WHERE unresolved > 0)"""


@query("gap_detection", f"WITH {GAPS} SELECT * FROM gp")
def _(t):
    return needs.gaps(gap_state(t), "question")


@query("gap_priority_bar", f"WITH {GAPS} SELECT question, arg_max(gap_type, (priority, gap_type)) AS gap_type, max(priority) AS priority, bool_or(priority >= 0.5) AS again FROM gp GROUP BY 1")
def _(t):
    return needs.top_gap(needs.gaps(gap_state(t), "question"), "question")


@query("hypothesis_seeding", f"""WITH {ASKED}, hy AS (SELECT item_id, text, {terms_sql('text', 3, X.QUESTION_STOP, 'a-z0-9_')} AS h FROM (SELECT doc_id AS item_id, text FROM documents WHERE lang = 'en' AND n_chars < 3000)), qt AS (SELECT conv_id, turn, {terms_sql('text', 3, X.QUESTION_STOP, 'a-z0-9_')} AS q FROM conversations WHERE role = 'system'),
  qe AS (SELECT conv_id, turn, len(q) AS nq, unnest(q) AS w FROM qt), he AS (SELECT item_id, len(h) AS nh, unnest(h) AS w FROM hy), c AS (SELECT conv_id, turn, item_id, count(*) AS sh, max(nq) AS nq, max(nh) AS nh FROM qe JOIN he USING (w) GROUP BY 1, 2, 3)
  SELECT conv_id, turn, item_id, round(sh / (nq + nh - sh), 6) AS overlap, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(sh / (nq + nh - sh), 6) DESC, item_id) AS r FROM c) WHERE r <= 3""")
def _(t):
    side = lambda df, n, *keys: df.select(*keys, X.ascii_terms(F.col("text"), 3, X.QUESTION_STOP).alias(n))
    h = side(t.documents.filter("lang = 'en' and n_chars < 3000").withColumnRenamed("doc_id", "item_id"), "h", "item_id")
    q = side(t.conversations.filter("role = 'system'"), "q", "conv_id", "turn")
    return planning.seeded(q, ["conv_id", "turn"], h, "item_id", 3)


# ---- values, attributes, claims ------------------------------------------------------------------------------------------------


@query("metric_values", rf"WITH {REPORTS}, ch AS (SELECT chunk_id AS question, 0 AS n, text AS low FROM reports), {VALUE_ROWS} SELECT question AS chunk_id, metric, value, CASE unit WHEN 'billion' THEN 'B' WHEN 'million' THEN 'M' WHEN 'thousand' THEN 'K' WHEN 'percent' THEN '%' ELSE unit END AS unit, value * CASE unit WHEN 'million' THEN 1e-3 WHEN 'thousand' THEN 1e-6 ELSE 1 END AS billions FROM vr WHERE value <> 0 AND NOT (unit = '' AND value BETWEEN 2000 AND 2099)")
def _(t):
    return extraction.metric_values(frames.reports(t), ["chunk_id"])


@query("metric_values_by_year", rf"""WITH {REPORTS}, sx AS (SELECT chunk_id, text, string_split(regexp_replace(text, '\.([^0-9]|$)', chr(1) || '\1', 'g'), chr(1)) AS ss FROM reports),
  sy AS (SELECT chunk_id, text, unnest(ss) AS s FROM sx), ch AS (SELECT chunk_id AS question, coalesce(list_min(list_transform(regexp_extract_all(s, '\b(20[0-9]{{2}})\b', 1), lambda x: CAST(x AS INTEGER))), list_min(list_transform(regexp_extract_all(text, '\b(20[0-9]{{2}})\b', 1), lambda x: CAST(x AS INTEGER))), 0) AS n, s AS low FROM sy), {VALUE_ROWS}
  SELECT question AS chunk_id, metric, value, CASE unit WHEN 'billion' THEN 'B' WHEN 'million' THEN 'M' WHEN 'thousand' THEN 'K' WHEN 'percent' THEN '%' ELSE unit END AS unit, n AS year FROM vr WHERE value <> 0 AND NOT (unit = '' AND value BETWEEN 2000 AND 2099)""")
def _(t):
    return conflicts.values_by_year(frames.reports(t), ["chunk_id"])


@query("temporal_context", rf"WITH {REPORTS} SELECT chunk_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\b(20[0-9]{{2}})\b', 1), lambda x: CAST(x AS INTEGER)))) AS years, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\bQ([1-4])\b', 1), lambda x: 'Q' || x))) AS quarters, TRY_CAST(nullif(regexp_extract(text, '\bas of\b.*?\b(20[0-9]{{2}})\b', 1), '') AS INTEGER) AS as_of FROM reports")
def _(t):
    x = F.col("text")
    return frames.reports(t).select("chunk_id", X.years(x).alias("years"), conflicts.quarters(x).alias("quarters"), conflicts.as_of_year(x).alias("as_of"))


@query("name_keywords", rf"WITH {REPORTS} SELECT chunk_id, list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(text, '\b([A-Z][a-z]{{2,}})\b', 1), lambda x: lower(x))), lambda x: NOT list_contains({sql_list(conflicts.NO_NAMES)}, x))) AS names FROM reports")
def _(t):
    return frames.reports(t).select("chunk_id", F.array_sort(conflicts.name_words(F.col("text"))).alias("names"))


_ATTR = "list_concat(" + ", ".join(f"list_transform(regexp_extract_all(text, '(?i){p}', 1), lambda v, i: {{'category': '{c}', 'value': v, 'unit': lower(regexp_extract_all(text, '(?i){p}', 2)[i])}})" for p, c in conflicts.ATTRIBUTES) + ")"
ATTR = f"""att AS (SELECT question, rank, chunk_id, doc_id, a.category AS category, a.value AS value, coalesce(a.unit, '') AS unit, CASE WHEN a.unit IN ('%', 'percent') THEN 'percentage' WHEN a.unit IN ('billion', 'million', 'thousand', '$', 'k', 'm', 'b') THEN 'financial' ELSE 'count' END AS unit_group FROM (SELECT question, rank, chunk_id, doc_id, unnest({_ATTR}) AS a FROM reports) WHERE a.value <> '')"""


@query("attribute_claims", f"WITH {REPORTS}, {ATTR} SELECT chunk_id, category, value, unit, unit_group FROM att")
def _(t):
    return conflicts.attribute_claims(frames.reports(t), ["chunk_id"])


@query("attribute_conflicts", f"WITH {REPORTS}, {ATTR}, d AS (SELECT DISTINCT question, rank, doc_id, category, unit_group, value FROM att) SELECT x.question, x.rank AS a, y.rank AS b, x.category, x.value AS value_a, y.value AS value_b, 0.7::DOUBLE AS severity FROM d x JOIN d y ON x.question = y.question AND x.category = y.category AND x.unit_group = y.unit_group AND x.rank < y.rank AND x.doc_id <> y.doc_id AND x.value <> y.value")
def _(t):
    return conflicts.attribute_conflicts(conflicts.attribute_claims(frames.reports(t), ["question", "rank", "doc_id"]), "question", "rank", "doc_id")


CLAIMS = f"""{frames.REPORTS}, claims AS (SELECT chunk_id AS id, text, source % 7 AS subject, CASE rank WHEN 1 THEN 'rose' WHEN 2 THEN 'Increased ' WHEN 3 THEN 'said' ELSE 'stated' END AS predicate, CASE WHEN rank = 6 THEN doc_id % 11 END AS object,
    CASE WHEN rank = 6 THEN NULL WHEN kind = 'AF' THEN 'High' WHEN kind = 'NO' THEN 'low' ELSE 'mid' END AS object_value, year * 12 AS valid_from, CASE WHEN rank % 2 = 0 THEN year * 12 + 6 END AS valid_to, CASE WHEN rank <> 5 THEN year END AS published_at, array(doc_id, source) AS chunk_ids FROM reports WHERE q_no <= 12)"""
CLAIMS_SQL = frames.plain(CLAIMS).replace("array(doc_id, source)", "[doc_id, source]")
GROUP = "CASE " + " ".join(f"WHEN lower(trim(predicate)) IN ({', '.join(chr(39) + w + chr(39) for w in g)}) THEN '{g[0]}'" for g in extraction.PREDICATE_GROUPS) + " ELSE lower(trim(predicate)) END"


def claims(t):
    return frames.frame(t, CLAIMS, "claims")


@query("predicate_groups", f"WITH {CLAIMS_SQL} SELECT id, {GROUP} AS predicate FROM claims")
def _(t):
    return claims(t).select("id", extraction.predicate_group(F.col("predicate")).alias("predicate"))


@query("claim_pair_conflicts", rf"""WITH {CLAIMS_SQL}, c AS (SELECT *, {GROUP} AS p, lower(object_value) AS lv, lower(coalesce(object_value, CAST(object AS VARCHAR))) AS o, list_sort(list_distinct(chunk_ids)) AS ids, list_transform(regexp_extract_all(text, '(\d+(?:\.\d+)?)', 1), lambda x: CAST(x AS DOUBLE)) AS n,
    list_transform(regexp_extract_all(text, '(?i)(\d+(?:\.\d+)?)\s*(?:percent|%|dollars?|\$|million|billion|trillion)', 1), lambda x: CAST(x AS DOUBLE)) AS m, list_filter({sql_list(conflicts.GEOGRAPHIC)}, lambda g: contains(lower(text), g)) AS g FROM claims),
  j AS (SELECT x.id AS a, y.id AS b, x AS l, y AS r FROM c x JOIN c y ON x.id < y.id AND (x.subject = y.subject OR x.object = y.object OR x.p = y.p AND x.lv = y.lv))
  SELECT a, b, k.kind AS kind, k.severity AS severity FROM (SELECT a, b, unnest(list_filter([
    CASE WHEN lower(trim(l.text)) = lower(trim(r.text)) AND l.published_at <> r.published_at THEN {{'kind': 'publication_date', 'severity': 0.7::DOUBLE}} END,
    CASE WHEN len(l.n) > 0 AND len(r.n) > 0 AND l.subject IS NOT DISTINCT FROM r.subject AND l.n[1] <> r.n[1] THEN {{'kind': 'metric_definition', 'severity': 0.8::DOUBLE}} END,
    CASE WHEN len(l.g) > 0 AND len(r.g) > 0 AND l.g <> r.g AND l.subject IS NOT DISTINCT FROM r.subject THEN {{'kind': 'geographic_scope', 'severity': 0.6::DOUBLE}} END,
    CASE WHEN l.subject IS NOT DISTINCT FROM r.subject AND (l.valid_to < r.valid_from OR r.valid_to < l.valid_from) AND l.valid_to IS NOT NULL AND r.valid_to IS NOT NULL THEN {{'kind': 'time_period', 'severity': 0.7::DOUBLE}} END,
    CASE WHEN len(l.m) > 0 AND len(r.m) > 0 AND l.subject IS NOT DISTINCT FROM r.subject AND l.p = r.p AND l.m <> r.m AND l.published_at <> r.published_at THEN {{'kind': 'revised_numbers', 'severity': 0.8::DOUBLE}} END,
    CASE WHEN l.subject <> r.subject AND l.p = r.p THEN {{'kind': 'entity_mismatch', 'severity': 0.5::DOUBLE}} END,
    CASE WHEN l.subject IS NOT DISTINCT FROM r.subject AND l.p = r.p AND l.o <> r.o AND l.ids <> r.ids THEN {{'kind': 'source_conflict', 'severity': 0.9::DOUBLE}} END,
    CASE WHEN l.subject IS NOT DISTINCT FROM r.subject AND l.p = r.p AND l.lv <> r.lv AND l.valid_from <= coalesce(r.valid_to, r.valid_from) AND r.valid_from <= coalesce(l.valid_to, l.valid_from) THEN {{'kind': 'temporal_conflict', 'severity': 0.8::DOUBLE}} END], lambda z: z IS NOT NULL)) AS k FROM j)""")
def _(t):
    return conflicts.claim_conflicts(claims(t))


@query("value_sets_disjoint", rf"WITH {REPORTS}, ch AS (SELECT question, rank AS n, lower(text) AS low FROM reports), {VALUE_ROWS} SELECT x.question, x.metric, x.n AS i, y.n AS j, NOT list_has_any(x.vs, y.vs) AS disjoint FROM vs x JOIN vs y ON x.question = y.question AND x.metric = y.metric AND x.n < y.n")
def _(t):
    v = extraction.metric_values(frames.reports(t).select("question", F.col("rank").alias("n"), F.lower("text").alias("text")), ["question", "n"]).filter("value > 0")
    scale = F.when(F.col("unit") == "M", 0.001).when(F.col("unit") == "K", 0.000001).otherwise(1.0)
    s = v.groupBy("question", "n", "metric").agg(F.collect_set(F.col("value") * scale).alias("vs"))
    p = s.select("question", "metric", F.col("n").alias("i"), F.col("vs").alias("x")).join(s.select("question", "metric", F.col("n").alias("j"), F.col("vs").alias("y")), ["question", "metric"]).filter("i < j")
    return p.select("question", "metric", "i", "j", (~F.arrays_overlap("x", "y")).alias("disjoint"))


@query("number_matching", rf"""WITH {REPORTS}, nm AS (SELECT question, rank, CAST(regexp_extract(text, '\$([0-9]+) million', 1) AS DOUBLE) AS v FROM reports WHERE regexp_matches(text, '\$([0-9]+) million')) SELECT x.question, x.rank AS i, y.rank AS j, x.v = y.v AS same, CASE WHEN x.v = 0 OR y.v = 0 THEN abs(x.v - y.v) / 10 < 1 WHEN x.v % 10 = 0 AND y.v % 10 = 0 THEN x.v = y.v ELSE abs(x.v / 10 - y.v / 10) / greatest(x.v / 10, y.v / 10) < 0.01 END AS close FROM nm x JOIN nm y ON x.question = y.question AND x.rank < y.rank""")
def _(t):
    v = frames.reports(t).select("question", "rank", F.regexp_extract("text", r"\$([0-9]+) million", 1).try_cast("double").alias("v")).filter("v is not null")
    p = v.select("question", F.col("rank").alias("i"), F.col("v").alias("x")).join(v.select("question", F.col("rank").alias("j"), F.col("v").alias("y")), "question").filter("i < j")
    return p.select("question", "i", "j", X.numbers_match(F.col("x"), F.col("y")).alias("same"), X.numbers_match(F.col("x") / 10, F.col("y") / 10).alias("close"))
