"""Evidence needs of a question: entities, topics, plans, coverage, verification of needs and hops, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlight.functions import text as X

# Words that are neither topics nor entities.
TOPIC_STOP = [
    "what", "how", "why", "when", "where", "who", "which", "is", "are", "was", "were", "does", "do", "did", "has", "have", "had", "can", "could", "should", "would", "will", "the", "a", "an", "and", "or",
    "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "this", "that", "these", "those", "it", "its", "their", "they", "we", "our", "you", "your", "he", "she", "his", "her", "my",
    "about", "into", "through", "during", "before", "after", "between", "under", "above", "over", "more", "most", "than", "then", "also", "not", "no", "any", "each", "every", "all", "both", "few", "many",
    "much", "some", "such", "only", "other", "very", "just", "if", "so", "too", "here", "there", "now", "still", "even", "well", "back", "being", "get", "got", "make", "made", "take", "took",
    "come", "came", "go", "went", "see", "saw", "know", "knew", "think", "thought", "say", "said", "tell", "told", "give", "gave", "use", "used", "find", "found", "want", "need", "needed",
    "been", "one", "way", "them", "like", "out", "time", "new", "year", "old", "great",
]
# Where one question turns into several, in order; the first groups keep the character before the cut.
CONNECTORS = [
    r"\band\s+(?:evaluate|assess|explain|analyze|consider|discuss|review|describe|compare)\b", r"\band\s+(?:what|how|why|which|where|who|when)\b", r"\band\s+(?:it|its|this|that|the)\b",
    r"(\.)\s+(?:Also|Additionally|Furthermore|Moreover)\b", r";\s*", r"(\w)\s+while\s+", r"(\w)\s+whereas\s+", r"(\w)\s+but\s+(?:also|additionally)\b",
]
COMPOUND = r"(\w+(?:\s+\w+){0,3})\s+and\s+(\w+(?:\s+\w+){0,3})"
# Patterns and words by which evidence meets a kind of need.
DISCLAIMER = (
    r"\b(important\s+note|note:|disclaimer|warning|caution|this\s+(document|report)\s+(does\s+not|contains|is)|where\s+figures\s+conflict|the\s+\d+\s+report\s+is\s+authoritative|"
    r"legacy\s+report|superseded|not\s+audited|illustrative|must\s+use\s+the\s+current|any\s+question\s+about)\b"
)
CONFLICT_WORDS = r"\b(different|conflict|contradict|however|although|but|legacy|superseded|alternative|disagree)\b"
SPECIFIC = r"\d{4}|\d+%|\$[\d,]+|\d+\.\d+"
CONFLICT_INDICATORS = ["conflict", "disagree", "however", "although", "contrary", "different", "revised", "updated"]
CAVEAT_INDICATORS = ["note", "however", "limitation", "disclaimer", "caveat", "except", "exclusion", "not include"]
DISCLAIMER_SEARCHES = [" disclaimer note", " authoritative report"]
CONFLICT_SEARCHES = [" disagree contradict", " however although"]
#: Patterns whose questions are planned.
PLANNED = ["conflict", "complex_research", "multi_hop"]
#: Results a recovery may add, searches it may make.
MOST_RECOVERED, MOST_SEARCHES = 6, 2


def entities(text: Column, most: int = 5) -> Column:
    """The first `most` distinct runs of capitalised words, without stop words and words that begin a sentence."""
    t = X.masked_ascii(text)
    found = F.regexp_extract_all(t, F.lit(r"\b([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*)\b"), 1)
    starts = F.regexp_extract_all(t, F.lit(r"(?:^|[.!?]\s+)(\w+)"), 1)
    return F.slice(F.filter(F.array_except(found, starts), lambda e: ~F.lower(e).isin(TOPIC_STOP)), 1, most)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def topic(text: Column, most: int = 6) -> Column:
    """The first `most` words of three letters or digits and more that are no stop words."""
    clean = F.transform(words(text), lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z0-9]", "")))
    return F.array_join(F.slice(F.filter(clean, lambda w: (F.length(w) > 2) & ~w.isin(TOPIC_STOP)), 1, most), " ")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def topics(text: Column, least: int = 10) -> Column:
    """The topics of a question's parts between connectors; of one that has none, the sides of its `and`, else its own topic.

    Parts of more than `least` characters count; one whose topic is a single word is taken whole, without punctuation.
    """
    cut = text
    for c in CONNECTORS:
        cut = F.regexp_replace(cut, "(?i)" + c, "$1\u0001" if c.startswith(("(\\.", "(\\w")) else "\u0001")
    parts = F.filter(F.transform(F.split(cut, "\u0001"), lambda p: F.regexp_replace(stripped(p), r"^\.+|\.+$", "")), lambda p: F.length(p) > least)

    def of_part(p):
        t = topic(p)
        bare = stripped(F.regexp_replace(p, r"[^a-zA-Z0-9\s]", ""))
        return F.when(F.length(t) > 3, F.when((F.size(F.split(t, " ")) < 2) & (F.size(words(p)) > 2), F.nullif(bare, F.lit(""))).otherwise(t))

    found = F.filter(F.transform(parts, of_part), lambda t: t.isNotNull())
    left, right = (F.regexp_extract_all(text, F.lit("(?i)" + COMPOUND), i) for i in (1, 2))
    sides = F.flatten(F.zip_with(left, right, lambda a, b: F.filter(F.array(stripped(a), stripped(b)), lambda x: F.length(x) > 3)))
    out = F.when((F.size(found) <= 1) & (F.size(left) > 0), sides).otherwise(found)
    return F.when(F.size(out) > 0, out).otherwise(F.array(topic(text)))


def _need(claim_type: str, priority, topic_col: Column, names: Column, search: Column, opposing: bool = False) -> Column:
    priority = F.lit(priority) if isinstance(priority, str) else priority
    return F.struct(F.lit(claim_type).alias("claim_type"), priority.alias("priority"), topic_col.alias("topic"), names.alias("entities"), search.alias("search_query"), F.lit(opposing).alias("opposing"))


def _pairs(e: Column) -> Column:
    """[a, b] for the pairs i < j of an array."""
    return F.flatten(F.transform(e, lambda a, i: F.transform(F.slice(e, i + 2, F.size(e)), lambda b: F.array(a, b))))


def plan(questions: DataFrame, key: str, text_col: str = "text", pattern_col: str = "pattern") -> DataFrame:
    """(key, pattern, need_no, claim_type, priority, topic, entities, search_query, opposing) of the questions that are planned.

    conflict: primary evidence, data (no year in the question), opposing evidence and caveats, the last three only with
    entities. complex_research: a need for each topic. multi_hop: the question, the pairs of its entities (five at most),
    then each of them. Other patterns have no plan. Arrays of a fixed size per question, no self-join.
    """
    q = questions.filter(F.col(pattern_col).isin(PLANNED)).select(key, F.col(pattern_col).alias("pattern"), F.col(text_col).alias("_t"), entities(F.col(text_col)).alias("_e"), topic(F.col(text_col)).alias("_p"), topics(F.col(text_col)).alias("_s"))
    t, e, p = F.col("_t"), F.col("_e"), F.col("_p")
    has, named = F.size(e) > 0, F.array_join(e, " ")
    primary = _need("primary", "high", p, e, t)
    conflict = F.array(
        primary,
        F.when(has & ~t.rlike(r"\b20\d{2}\b"), _need("supporting", "high", p, e, F.concat(named, F.lit(" latest data figures")))),
        F.when(has, _need("contradictory", "high", p, e, F.concat(named, F.lit(" "), p, F.lit(" discrepancy alternative source")), True)),
        F.when(has, _need("caveat", "medium", p, e, F.concat(named, F.lit(" "), p, F.lit(" caveat exception limitation note")))),
    )
    lead = F.slice(e, 1, 2)
    research = F.transform("_s", lambda x, i: _need("primary", F.when(i == 0, "high").otherwise("medium"), x, e, F.array_join(F.concat(F.filter(F.array(F.array_join(lead, " ")), lambda y: y != ""), F.array(x)), " ")))
    hops = F.concat(
        F.array(primary),
        F.transform(_pairs(e), lambda x: _need("contextual", "medium", F.array_join(x, " - "), x, F.concat(F.array_join(x, " "), F.lit(" "), p))),
        F.transform(e, lambda x: _need("supporting", "medium", x, F.array(x), F.concat(x, F.lit(" "), p))),
    )
    needs = F.when(F.col("pattern") == "conflict", F.filter(conflict, lambda x: x.isNotNull())).when(F.col("pattern") == "complex_research", research).otherwise(hops)
    return q.select(key, "pattern", F.posexplode(needs).alias("need_no", "n")).select(key, "pattern", "need_no", "n.*")


def _topic_word(topic_col: Column, low: Column) -> Column:
    """Whether a word of over three letters of the topic occurs in the text."""
    return F.exists(F.split(F.lower(topic_col), " "), lambda w: (F.length(w) > 3) & F.contains(low, w))


def _entity(names: Column, low: Column, least: int = 0) -> Column:
    return F.exists(names, lambda e: (F.length(e) > least) & F.contains(low, F.lower(e)))


def coverage(needs: DataFrame, evidence: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """needs with `satisfied`: whether the evidence (key, text) of the question meets the need.

    caveat: a disclaimer; primary: topic, entity and a figure in one text; contradictory: an opposing word and the topic;
    others: topic or entity. Evidence is the few hits of each question, so needs and hits meet on the question.
    """
    e = evidence.select(key, F.col(text_col).alias("_x"), F.lower(text_col).alias("_l"))
    low, raw = F.col("_l"), F.col("_x")
    said, named = _topic_word(F.col("topic"), low), _entity(F.col("entities"), low)
    hit = (
        F.when(F.col("claim_type") == "caveat", raw.rlike("(?i)" + DISCLAIMER)).when(F.col("claim_type") == "primary", said & named & raw.rlike(SPECIFIC))
        .when(F.col("claim_type") == "contradictory", raw.rlike("(?i)" + CONFLICT_WORDS) & said).otherwise(said | named)
    )
    met = needs.select(key, "need_no", "claim_type", "topic", "entities").join(e, key).groupBy(key, "need_no").agg(F.bool_or(hit).alias("_met"))
    return needs.join(met, [key, "need_no"], "left").withColumn("satisfied", F.coalesce("_met", F.lit(False))).drop("_met")


def recovery_type(pattern: Column, unmet: Column) -> Column:
    """How evidence for unmet needs (an array of their types) is sought: none, disclaimer, related_claim, bridge, ..."""
    return (
        F.when(F.size(unmet) == 0, "none")
        .when(pattern == "conflict", F.when(F.array_contains(unmet, "caveat"), "disclaimer").when(F.array_contains(unmet, "contradictory"), "related_claim").otherwise("parent_context"))
        .when(pattern == "multi_hop", "bridge").when(pattern == "complex_research", "section_expansion").otherwise("parent_context")
    )


def coverage_by_plan(covered: DataFrame, key: str) -> DataFrame:
    """(key, pattern, needs, satisfied, ratio, first_unmet, recovery) from coverage()."""
    unmet = F.collect_list(F.when(~F.col("satisfied"), F.col("claim_type")))
    g = covered.groupBy(key, "pattern").agg(F.count(F.lit(1)).alias("needs"), F.count_if("satisfied").alias("satisfied"), unmet.alias("_u"), F.min(F.when(~F.col("satisfied"), F.col("need_no"))).alias("first_unmet"))
    return g.select(key, "pattern", "needs", "satisfied", (F.col("satisfied") / F.col("needs")).alias("ratio"), "first_unmet", recovery_type(F.col("pattern"), F.col("_u")).alias("recovery"))


def bridge_entities(needs: DataFrame, evidence: DataFrame, key: str, order: str, text_col: str = "text", most: int = 3) -> DataFrame:
    """(key, need_no, bridges): the first `most` names in the question's evidence that the need does not have itself."""
    found = evidence.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text_col).alias("x")))), lambda s: s["x"]), " ").alias("_x"))
    names = F.array_distinct(F.filter(X.proper_nouns(F.col("_x")), lambda n: ~F.array_contains(F.transform("entities", F.lower), F.lower(n))))
    return needs.join(found, key).select(key, "need_no", F.slice(names, 1, most).alias("bridges"))


def recovery_searches(covered: DataFrame, evidence: DataFrame, key: str, order: str, text_col: str = "text") -> DataFrame:
    """(key, recovery, call_no, search_query): the searches (two at most) by which unmet needs are sought again.

    disclaimer and related_claim put words to the first unmet need's topic. bridge searches the first bridge of each unmet
    need in turn, then the second. section_expansion searches the beginning of the best hits (over 0.5), by `order`.
    """
    plans = coverage_by_plan(covered, key)
    unmet = covered.filter(~F.col("satisfied")).join(plans.select(key, "recovery", "first_unmet"), key)
    first = unmet.filter((F.col("need_no") == F.col("first_unmet")) & F.col("recovery").isin("disclaimer", "related_claim"))
    added = F.when(F.col("recovery") == "disclaimer", X.literal_array(DISCLAIMER_SEARCHES)).otherwise(X.literal_array(CONFLICT_SEARCHES))
    worded = first.select(key, "recovery", F.posexplode(added).alias("i", "s"), "topic").select(key, "recovery", F.col("i").alias("a"), F.lit(0).alias("b"), F.concat("topic", "s").alias("search_query"))
    hops = bridge_entities(unmet.filter("recovery = 'bridge'").select(key, "recovery", "need_no", "topic", "entities"), evidence, key, order, text_col)
    hops = unmet.select(key, "recovery", "need_no", "topic").join(hops, [key, "need_no"]).select(key, "recovery", F.col("need_no").alias("b"), "topic", F.posexplode("bridges").alias("a", "name"))
    hops = hops.select(key, "recovery", "a", "b", F.concat("name", F.lit(" "), "topic").alias("search_query"))
    best = evidence.filter("score > 0.5").select(key, F.col(order).alias("a"), F.lit(0).alias("b"), F.substring(text_col, 1, 100).alias("search_query"))
    best = best.join(plans.filter("recovery = 'section_expansion'").select(key, "recovery"), key).select(key, "recovery", "a", "b", "search_query")
    every = worded.unionByName(hops).unionByName(best)
    w = Window.partitionBy(key).orderBy("a", "b")
    return every.withColumn("call_no", F.row_number().over(w)).filter(F.col("call_no") <= MOST_SEARCHES).select(key, "recovery", "call_no", "search_query")


def recovered(searches: DataFrame, hits: DataFrame, evidence: DataFrame, key: str, item: str, text_col: str = "text") -> DataFrame:
    """(key, item, position): what the searches' hits (key, call_no, rank, item, text) add to a question's evidence.

    Items the question has already are left out; a disclaimer search adds its first hit with a disclaimer only; six at most.
    """
    new = searches.select(key, "call_no", "recovery").join(hits, [key, "call_no"]).join(evidence.select(key, item), [key, item], "left_anti")
    note = new.filter((F.col("recovery") != "disclaimer") | F.col(text_col).rlike("(?i)" + DISCLAIMER))
    first = F.row_number().over(Window.partitionBy(key, "call_no").orderBy("rank"))
    kept = note.withColumn("_f", first).filter((F.col("recovery") != "disclaimer") | (F.col("_f") == 1))
    once = kept.groupBy(key, item).agg(F.min(F.struct("call_no", "rank")).alias("_o"))
    return once.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("_o"))).filter(F.col("position") <= MOST_RECOVERED).select(key, item, "position")


def verified_needs(needs: DataFrame, evidence: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, need_no, status, score, supporting, partial): how selected evidence covers each need.

    primary: topic and entity support, one of them is a partial match; contradictory and caveat: an indicator supports,
    the topic alone is partial; supporting: topic or entity; contextual: topic. Without evidence no_evidence_exists.
    """
    e = evidence.select(key, F.lower(text_col).alias("_l"))
    low = F.col("_l")
    said, named = F.contains(low, F.lower("topic")), _entity(F.col("entities"), low, 2)
    kind = F.col("claim_type")
    yes = (
        F.when(kind == "primary", said & named).when(kind == "contradictory", X.any_in(low, CONFLICT_INDICATORS)).when(kind == "supporting", said | named)
        .when(kind == "caveat", X.any_in(low, CAVEAT_INDICATORS)).otherwise(said)
    )
    half = F.when(kind == "primary", said | named).when(kind.isin("contradictory", "caveat"), said).otherwise(False)
    g = needs.select(key, "need_no", "claim_type", "topic", "entities").join(e.withColumn("_any", F.lit(True)), key, "left").groupBy(key, "need_no").agg(
        F.count("_any").alias("_n"), F.count_if(yes).alias("supporting"), F.count_if(~yes & half).alias("partial"), F.max(F.when(said | named, 1).otherwise(0)).alias("_hop")
    )
    status = F.when(F.col("_n") == 0, "no_evidence_exists").when(F.col("supporting") > 0, "covered").when(F.col("partial") > 0, "partially_covered").otherwise("not_covered")
    g = g.withColumn("status", status)
    return g.select(key, "need_no", "status", F.when(F.col("status") == "covered", 1.0).when(F.col("status") == "partially_covered", 0.5).otherwise(0.0).alias("score"), "supporting", "partial", (F.col("_hop") == 1).alias("hop_covered"))


def verified_chains(verified: DataFrame, key: str) -> DataFrame:
    """(key, hops, covered, status, weakest): hop chains from verified_needs(); weakest is the first uncovered hop, -1 if none."""
    g = verified.groupBy(key).agg(F.count(F.lit(1)).alias("hops"), F.count_if("hop_covered").alias("covered"), F.min(F.when(~F.col("hop_covered"), F.col("need_no"))).alias("_w"))
    status = F.when(F.col("covered") == F.col("hops"), "covered").when(F.col("covered") > 0, "partially_covered").otherwise("not_covered")
    return g.select(key, "hops", "covered", status.alias("status"), F.coalesce("_w", F.lit(-1)).alias("weakest"))


def coverage_selection(hits: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The k best hits by score with rank and selection_score, a diagnostic that orders nothing.

    hits has need (the owner), high (its priority is high), shared (several needs found it) and source. The score gains
    for the first hit of a need, for high priority and for shared hits, and loses after three better ones of its source.
    """
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), item)
    r = hits.withColumn("rank", F.row_number().over(w))
    first = F.row_number().over(Window.partitionBy(group, "need").orderBy(F.col("score").desc(), item)) == 1
    crowd = F.row_number().over(Window.partitionBy(group, "source").orderBy(F.col("score").desc(), item)) > 3
    s = F.col("score") * F.when(first, 1.3).otherwise(1.0) * F.when(F.col("high"), 1.2).otherwise(1.0) * F.when(F.col("shared"), 1.15).otherwise(1.0) * F.when(crowd, 0.7).otherwise(1.0)
    return r.withColumn("selection_score", s).filter(F.col("rank") <= k)


def gaps(state: DataFrame, key: str, quality: float = 0.3) -> DataFrame:
    """(key, gap_type, suggested_query, priority): what a question's evidence lacks, each once.

    state: query, objective, found, best, subquestions and issued (arrays of strings), unresolved (critical contradictions).
    A subquestion is covered if an issued query shares a term of three letters or more with it.
    """
    terms = lambda x: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9_]{3,})"), 1)), X.literal_array(X.QUESTION_STOP))
    missing = F.filter("subquestions", lambda s: ~F.exists("issued", lambda q: F.arrays_overlap(terms(s), terms(q))))
    n, lost = F.size("subquestions"), F.size(missing)
    low = F.lower("query")
    gap = lambda kind, search, p: F.struct(F.lit(kind).alias("gap_type"), search.alias("suggested_query"), F.lit(p).alias("priority"))
    better = F.when(F.contains(low, F.lit("define")) | F.contains(low, F.lit("definition")), F.col("query")).otherwise(F.concat("query", F.lit(" definition and supporting evidence")))
    found = F.concat(
        F.array(F.when(F.col("found") == 0, gap("no_evidence", F.col("query"), 0.9))),
        F.transform(missing, lambda s: gap("missing_evidence", s, 0.8)),
        F.array(
            F.when((n > 0) & ((n - lost) / F.greatest(n, F.lit(1)) < 0.5), gap("low_coverage", F.coalesce("objective", "query"), 0.7)),
            F.when((F.col("found") > 0) & (F.col("best") < quality), gap("evidence_quality", better, 0.6)),
            F.when(F.col("unresolved") > 0, gap("contradiction_unresolved", F.concat("query", F.lit(" - resolution of conflicting evidence, authoritative sources")), 0.85)),
        ),
    )
    e = state.select(key, F.posexplode(F.filter(found, lambda x: x.isNotNull())).alias("_i", "g")).select(key, "_i", "g.*")
    w = Window.partitionBy(key, "gap_type", F.lower("suggested_query")).orderBy("_i")
    return e.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(key, "gap_type", "suggested_query", "priority")


def top_gap(found: DataFrame, key: str, bar: float = 0.5) -> DataFrame:
    """(key, gap_type, priority, again): the gap of highest priority, and whether any reaches the bar for another retrieval."""
    return found.groupBy(key).agg(F.max(F.struct("priority", "gap_type")).alias("g"), F.bool_or(F.col("priority") >= bar).alias("again")).select(key, "g.gap_type", "g.priority", "again")
