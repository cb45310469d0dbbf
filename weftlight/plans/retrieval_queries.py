"""Queries over documents, questions and vectors: chunking, lexical and dense search, fusion, selection, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlight.functions import text as X
from weftlight.operators import chunking, dense, evaluation, fusion, lexical, selection
from weftlight.plans.registry import query

CHUNKS = r"""chunks AS (
  SELECT doc_id, CAST(o AS INTEGER) AS ordinal, CAST(o * 448 AS INTEGER) AS char_start, CAST(least(o * 448 + 512, length(t)) AS INTEGER) AS char_end, substring(t, o * 448 + 1, 512) AS text
  FROM (SELECT doc_id, text AS t, unnest(range(0, CAST(ceil(length(text) / 448.0) AS BIGINT))) AS o FROM documents WHERE length(text) > 0)
  WHERE regexp_matches(substring(t, o * 448 + 1, 512), '\S'))"""
TOK = r"list_filter(string_split_regex(lower({}), '\s+'), lambda x: x <> '')"
LINES = r"""lines AS (
  SELECT doc_id, CAST(segment AS INTEGER) AS segment, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS seg_start
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS segment FROM documents))"""


@query("chunk_fixed_windows", f"WITH {CHUNKS} SELECT doc_id, ordinal, char_start, char_end, text, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS token_estimate FROM chunks")
def _(t):
    return chunking.windows(t.documents).withColumn("token_estimate", X.token_estimate(F.col("text")))


@query("line_segments", f"WITH {LINES} SELECT doc_id, segment, seg_start, CAST(seg_start + length(text) AS INTEGER) AS seg_end, text FROM lines")
def _(t):
    return chunking.lines(t.documents)


@query("chunk_segment_provenance", f"""WITH {CHUNKS}, {LINES} SELECT c.doc_id, c.ordinal, min(l.segment) AS page_start, max(l.segment) AS page_end, arg_min(l.text, l.segment) AS section
  FROM chunks c JOIN lines l ON c.doc_id = l.doc_id AND l.seg_start + length(l.text) > c.char_start AND l.seg_start < c.char_end GROUP BY 1, 2""")
def _(t):
    return chunking.provenance(chunking.windows(t.documents), chunking.lines(t.documents))


@query("chunk_section_fallback", rf"""WITH {LINES}, s AS (SELECT doc_id, segment, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM lines),
  c AS (SELECT doc_id, segment, 0 AS pos, t AS text FROM s WHERE t <> '' AND greatest(1, floor(length(t) / 4)) <= 512
        UNION ALL SELECT doc_id, segment, pos, substring(t, pos + 1, 512) FROM (SELECT *, unnest(range(0, length(t), 512)) AS pos FROM s WHERE t <> '' AND greatest(1, floor(length(t) / 4)) > 512))
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY segment, pos) - 1 AS INTEGER) AS ordinal, text FROM c WHERE regexp_matches(text, '\S')""")
def _(t):
    return chunking.sections(chunking.lines(t.documents))


@query("paragraph_packing")
def _(t):
    return chunking.packed_paragraphs(t.documents)


@query("sentence_split", r"""SELECT doc_id, count(*) AS n_sentences, sum(length(s)) AS n_chars FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents) WHERE trim(s) <> '' GROUP BY 1""")
def _(t):
    s = t.documents.select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"))


@query("doc_checksum_dedupe", "SELECT sha256(text) AS checksum, min(doc_id) AS doc_id, count(*) AS copies, min(source) AS source FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("checksum")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min("source").alias("source"))


@query("doc_version_chain", "SELECT doc_id, source, CAST(row_number() OVER w AS INTEGER) AS version, lead(1) OVER w IS NULL AS is_current FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)")
def _(t):
    return selection.latest_versions(t.documents.select("doc_id", "source", "n_chars"), "source", ["n_chars", "doc_id"]).drop("n_chars")


@query("latest_version_per_source", "SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars, count(*) AS n_versions FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.max_by("n_chars", "doc_id").alias("n_chars"), F.count(F.lit(1)).alias("n_versions"))


POST = f"post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY 1, 2)"
IDF = "corpus AS (SELECT count(*) AS n_items FROM documents), raw AS MATERIALIZED (SELECT term, df, ln((n_items - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY 1) d, corpus), low AS MATERIALIZED (SELECT 0.25 * avg(raw) AS least FROM raw), idf AS (SELECT term, df, CASE WHEN raw < 0 THEN least ELSE raw END AS idf FROM raw, low)"


def bm25_sql(items, item, asks, ask, k):
    """CTE lex{k}: the k best items (item, text) of every question (ask, text), with score and rank."""
    return f"""po AS (SELECT {item}, term, count(*) AS tf FROM (SELECT {item}, unnest({TOK.format('text')}) AS term FROM {items}) GROUP BY 1, 2), pn AS (SELECT count(*) AS n_items FROM {items}),
  pr AS MATERIALIZED (SELECT term, ln((n_items - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT term, count(*) AS df FROM po GROUP BY 1) d, pn), pm AS MATERIALIZED (SELECT 0.25 * avg(raw) AS least FROM pr), pi AS (SELECT term, CASE WHEN raw < 0 THEN least ELSE raw END AS idf FROM pr, pm),
  pd AS (SELECT {item}, len({TOK.format('text')}) AS dl FROM {items}), pa_ AS (SELECT avg(dl) AS avgdl FROM pd), pq AS (SELECT {ask}, term, count(*) AS qf FROM (SELECT {ask}, unnest({TOK.format('text')}) AS term FROM {asks}) GROUP BY 1, 2),
  pb AS (SELECT {ask}, po.{item}, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM pq JOIN pi USING (term) JOIN po USING (term) JOIN pd ON pd.{item} = po.{item}, pa_ GROUP BY 1, 2),
  lex{k} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {ask} ORDER BY score DESC, {item}) AS INTEGER) AS rank FROM pb) WHERE rank <= {k} AND score > 0)"""


@query("postings_build", f"WITH {POST} SELECT doc_id, term, tf FROM post")
def _(t):
    return lexical.postings(t.documents, ["doc_id"])


@query("doc_length_stats", f"WITH l AS (SELECT len({TOK.format('text')}) AS dl FROM documents) SELECT count(*) AS n_items, round(avg(dl), 6) AS avgdl, min(dl) AS shortest, max(dl) AS longest, sum(dl) AS total FROM l")
def _(t):
    return lexical.lengths(t.documents, ["doc_id"]).agg(F.count(F.lit(1)).alias("n_items"), F.round(F.avg("dl"), 6).alias("avgdl"), F.min("dl").cast("long").alias("shortest"), F.max("dl").cast("long").alias("longest"), F.sum("dl").alias("total"))


@query("idf_table", f"WITH {POST}, {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(t):
    d = t.documents
    return lexical.idf(lexical.postings(d, ["doc_id"]), d.agg(F.count(F.lit(1)).alias("n_items"))).withColumn("idf", F.round("idf", 6))


def questions(t):
    return t.benchmark.select("item_id", "text")


BM25 = f"""{POST}, {IDF}, dl AS (SELECT doc_id, len({TOK.format('text')}) AS dl FROM documents), stats AS (SELECT avg(dl) AS avgdl FROM dl),
  q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
  bm AS (SELECT item_id, p.doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
         FROM q JOIN idf USING (term) JOIN post p USING (term) JOIN dl USING (doc_id), stats GROUP BY 1, 2),
  lex AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm) WHERE rank <= 20 AND score > 0)"""


def lexical_hits(t, k=20):
    return lexical.bm25_top_k(t.documents, ["doc_id"], questions(t), "item_id", k)


@query("bm25_batch_questions", f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM lex")
def _(t):
    return lexical_hits(t)


@query("bm25_topk_chunks", rf"""WITH {CHUNKS}, post AS (SELECT doc_id, ordinal, term, count(*) AS tf FROM (SELECT doc_id, ordinal, unnest({TOK.format('text')}) AS term FROM chunks) GROUP BY 1, 2, 3),
  raw AS (SELECT term, ln(((SELECT count(*) FROM chunks) - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY 1)), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  dl AS (SELECT doc_id, ordinal, len({TOK.format('text')}) AS dl FROM chunks), stats AS (SELECT avg(dl) AS avgdl FROM dl),
  q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
  bm AS (SELECT item_id, p.doc_id, p.ordinal, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN idf USING (term) JOIN post p USING (term) JOIN dl USING (doc_id, ordinal), stats GROUP BY 1, 2, 3)
  SELECT item_id, doc_id, ordinal, score, CAST(rank AS INTEGER) AS rank, d.source, d.lang FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, ordinal) AS rank FROM bm) JOIN documents d USING (doc_id) WHERE rank <= 10 AND score > 0""")
def bm25_chunks(t):
    hits = lexical.bm25_top_k(chunking.windows(t.documents), ["doc_id", "ordinal"], questions(t), "item_id", 10)
    return hits.join(t.documents.select("doc_id", "source", "lang"), "doc_id")


@query("sparse_dot_topk", f"""WITH {POST}, q AS (SELECT item_id, term, count(*) AS qw FROM (SELECT item_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
  s AS (SELECT item_id, doc_id, CAST(sum(tf * qw) AS DOUBLE) AS score FROM q JOIN post USING (term) GROUP BY 1, 2)
  SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def _(t):
    return lexical.sparse_top_k(t.documents, ["doc_id"], questions(t), "item_id", 10)


# a question's vector is that of the document with its number
DENSE = """qv AS (SELECT b.item_id, e.embedding::DOUBLE[] AS v FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
  cs AS (SELECT item_id, vec_id AS doc_id, round(list_inner_product(v, e.embedding::DOUBLE[]) / sqrt(list_inner_product(v, v) * list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS score FROM qv, embeddings e WHERE e.vec_id <> item_id),
  den AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM cs) WHERE rank <= 20 AND score > 0)"""


def dense_hits(t, k=20):
    qv = t.benchmark.select("item_id").join(t.embeddings, F.col("item_id") == F.col("vec_id")).select("item_id", "embedding")
    return dense.cosine_top_k(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), qv, k, "doc_id", "embedding", "item_id")


@query("cosine_topk_batch", f"WITH {DENSE} SELECT item_id, doc_id, score, rank FROM den")
def _(t):
    return dense_hits(t)


@query("vector_norms", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding) AS dim FROM embeddings")
def _(t):
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), F.size("embedding").cast("long").alias("dim"))


CH = f"""{BM25}, {DENSE}, pairs AS (SELECT coalesce(l.item_id, d.item_id) AS item_id, coalesce(l.doc_id, d.doc_id) AS doc_id, l.score AS bm25, d.score AS cosine FROM lex l FULL JOIN den d ON l.item_id = d.item_id AND l.doc_id = d.doc_id),
  ch AS (SELECT *, CASE WHEN bm25 IS NOT NULL THEN row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC NULLS LAST, doc_id) END AS rb, CASE WHEN cosine IS NOT NULL THEN row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC NULLS LAST, doc_id) END AS rv,
    count(bm25) OVER q AS nb, count(cosine) OVER q AS nv, count(*) OVER q AS n, max(coalesce(bm25, 0)) OVER q AS mb, max(coalesce(cosine, 0)) OVER q AS mv, sum(coalesce(bm25, 0)) OVER q AS sb, sum(coalesce(cosine, 0)) OVER q AS sv
    FROM pairs WINDOW q AS (PARTITION BY item_id))"""
FUSED = {
    "max": "0.5 * CASE WHEN mb > 0 THEN coalesce(bm25, 0) / mb ELSE 0 END + 0.5 * coalesce(cosine, 0)",
    "rank": "0.5 * (n - coalesce(rb, n) + 1) / n + 0.5 * (n - coalesce(rv, n) + 1) / n",
    "max_of_both": "greatest(1.0 / coalesce(rb, 100), 1.0 / coalesce(rv, 100))",
    "rrf": "1.0 / (60 + coalesce(rb, nb + 1)) + 1.0 / (60 + coalesce(rv, nv + 1))",
    "sum_norm": "0.5 * CASE WHEN sb > 0 THEN coalesce(bm25, 0) / sb ELSE 0 END + 0.5 * CASE WHEN sv > 0 THEN coalesce(cosine, 0) / sv ELSE 0 END",
    "borda": "coalesce((n - rb + 1) / n, 0) + coalesce((n - rv + 1) / n, 0)",
    "dense_sparse": "0.5 * CASE WHEN mb > 0 THEN coalesce(bm25, 0) / mb ELSE 0 END + 0.5 * CASE WHEN mv > 0 THEN coalesce(cosine, 0) / mv ELSE 0 END",
}


def fused_sql(kind):
    return f"f_{kind} AS (SELECT item_id, doc_id, fused, CAST(row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS INTEGER) AS rank FROM (SELECT item_id, doc_id, round(CAST({FUSED[kind]} AS DOUBLE), 8) AS fused FROM ch))"


def frame(t):
    return fusion.channels(lexical_hits(t), dense_hits(t), "item_id", "doc_id")


for _kind in fusion.STRATEGIES:
    query("hybrid_rank_fusion" if _kind == "rank" else f"fuse_{_kind}", f"WITH {CH}, {fused_sql(_kind)} SELECT item_id, doc_id, fused, rank FROM f_{_kind} WHERE rank <= 10")(lambda t, kind=_kind: fusion.fuse(frame(t), kind, "item_id", "doc_id", 10))


@query("policy_multi_method_fusion", f"""WITH {BM25}, {DENSE}, h AS (SELECT item_id, doc_id, 'bm25' AS method, 0.4 AS weight, score FROM lex UNION ALL SELECT item_id, doc_id, 'vector', 0.6, score FROM den),
  w AS (SELECT *, CASE WHEN max(score) OVER m > 0 THEN score / max(score) OVER m * weight ELSE 0 END AS value FROM h WINDOW m AS (PARTITION BY item_id, method))
  SELECT item_id, doc_id, round(max(value), 6) AS score, arg_max(method, value) AS method FROM w GROUP BY 1, 2""")
def _(t):
    h = lexical_hits(t).select("item_id", "doc_id", F.lit("bm25").alias("method"), F.lit(0.4).alias("weight"), "score").unionByName(dense_hits(t).select("item_id", "doc_id", F.lit("vector").alias("method"), F.lit(0.6).alias("weight"), "score"))
    return fusion.merge_methods(h, "item_id", "doc_id").withColumn("score", F.round("score", 6))


@query("evidence_merge_max", f"WITH {BM25}, {DENSE} SELECT doc_id, max(score) AS score, count(*) AS times_found FROM (SELECT doc_id, score FROM lex UNION ALL SELECT doc_id, score FROM den) GROUP BY 1")
def _(t):
    return fusion.merge_evidence(lexical_hits(t).select("doc_id", "score").unionByName(dense_hits(t).select("doc_id", "score")), ["doc_id"])


@query("multi_need_merge", f"WITH {BM25} SELECT doc_id, min(item_id) AS owner, max(score) AS score, count(DISTINCT item_id) > 1 AS shared FROM lex GROUP BY 1")
def _(t):
    return fusion.merge_needs(lexical_hits(t), "item_id", "doc_id")


@query("citations_with_provenance", f"WITH {BM25} SELECT l.item_id, l.rank, l.doc_id, d.source, sha256(d.text) AS checksum, l.score FROM lex l JOIN documents d USING (doc_id)")
def _(t):
    return lexical_hits(t).join(t.documents.select("doc_id", "source", F.sha2("text", 256).alias("checksum")), "doc_id")


@query("orphan_vectors", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.embeddings.select("vec_id").join(t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@query("unembedded_documents", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(t):
    return t.documents.select("doc_id", "source").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("fetch_preserving_order", f"WITH {BM25}, ids AS (SELECT item_id, list(doc_id ORDER BY rank) AS ids FROM lex GROUP BY 1), e AS (SELECT item_id, unnest(ids) AS doc_id, generate_subscripts(ids, 1) AS position FROM ids) SELECT item_id, CAST(position - 1 AS INTEGER) AS position, doc_id, n_chars FROM e JOIN documents USING (doc_id)")
def _(t):
    ids = lexical_hits(t).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    return ids.select("item_id", F.posexplode("ids").alias("position", "doc_id")).join(t.documents.select("doc_id", "n_chars"), "doc_id")


SRC = f"{BM25}, h AS (SELECT item_id, doc_id, score, source FROM lex JOIN documents USING (doc_id))"


def sourced(t):
    return lexical_hits(t).drop("rank").join(t.documents.select("doc_id", "source"), "doc_id")


DIV = """l AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) > 1 AS follower FROM h),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY follower, score DESC, doc_id) AS place FROM l),
  div AS (SELECT item_id, doc_id, source, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE place <= 8)"""


@query("diversify_by_source", f"WITH {SRC}, {DIV} SELECT item_id, doc_id, source, score, rank FROM div")
def _(t):
    return selection.diversify(sourced(t), ["item_id"], "source", "doc_id", 8)


@query("conditional_diversify", f"""WITH {SRC}, {DIV}, p AS (SELECT * FROM (SELECT item_id, doc_id, source, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM h) WHERE rank <= 8),
  n AS (SELECT item_id, count(DISTINCT source) AS n FROM p GROUP BY 1) SELECT p.item_id, doc_id, source, score, rank FROM p JOIN n ON p.item_id = n.item_id AND n >= 6 UNION ALL SELECT div.item_id, doc_id, source, score, rank FROM div JOIN n ON div.item_id = n.item_id AND n < 6""")
def _(t):
    return selection.diversify_if_narrow(sourced(t), ["item_id"], "source", "doc_id", 8, 6)


@query("near_duplicate_selection")
def _(t):
    return selection.near_duplicates_removed(dense_hits(t).drop("rank").join(t.embeddings.withColumnRenamed("vec_id", "doc_id").select("doc_id", "embedding"), "doc_id"), ["item_id"], "doc_id", threshold=0.6).select("item_id", "doc_id", "score")


@query("token_budget_selection", f"""WITH {BM25}, h AS (SELECT item_id, doc_id, score, greatest(1, CAST(floor(n_chars / 4) AS BIGINT)) AS tokens FROM lex JOIN documents USING (doc_id)),
  r AS (SELECT *, sum(tokens) OVER w AS running_tokens, CAST(row_number() OVER w AS INTEGER) AS rank FROM h WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id))
  SELECT item_id, doc_id, score, tokens, CAST(running_tokens AS BIGINT) AS running_tokens, rank FROM r WHERE running_tokens <= 4000 OR rank <= 2""")
def _(t):
    h = lexical_hits(t).drop("rank").join(t.documents.select("doc_id", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("long").alias("tokens")), "doc_id")
    return selection.token_budget(h, ["item_id"], "doc_id", "tokens", 4000, 2)


@query("neighbour_chunks", f"WITH {CHUNKS} SELECT doc_id, ordinal, lag(ordinal) OVER w AS previous, lead(ordinal) OVER w AS next FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)")
def _(t):
    return selection.neighbours(chunking.windows(t.documents))


@query("parent_context_siblings", f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_siblings, min(ordinal) AS first, max(ordinal) AS last, sum(length(text)) AS chars FROM chunks GROUP BY 1")
def _(t):
    return chunking.windows(t.documents).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_siblings"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.sum(F.length("text")).alias("chars"))


# ---- metrics: the vectors of a question's label are its relevant items --------------------------------------------------

REL = "rel AS (SELECT b.item_id, e.vec_id AS doc_id FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id)"
METRICS = f"""{DENSE}, {REL}, n AS (SELECT item_id, count(*) AS n FROM rel GROUP BY 1), hit AS (SELECT d.*, CASE WHEN r.doc_id IS NOT NULL THEN 1 ELSE 0 END AS hit FROM den d LEFT JOIN rel r ON d.item_id = r.item_id AND d.doc_id = r.doc_id WHERE rank <= 10),
  per AS (SELECT item_id, sum(hit) AS hits, count(*) AS returned, min(CASE WHEN hit = 1 THEN rank END) AS first, coalesce(sum(CASE WHEN hit = 1 THEN 1 / log2(rank + 1) END), 0) AS dcg FROM hit GROUP BY 1),
  m AS (SELECT n.item_id, coalesce(hits / n.n, 0) AS recall, coalesce(hits / returned, 0) AS precision, coalesce(1.0 / first, 0) AS mrr, coalesce(dcg / list_sum(list_transform(range(1, least(n.n, 10) + 1), lambda r: 1 / log2(r + 1))), 0) AS ndcg FROM n LEFT JOIN per USING (item_id))"""


def metrics(t):
    e = t.embeddings.select("vec_id", "label")
    rel = t.benchmark.select("item_id").join(e, F.col("item_id") == F.col("vec_id")).select("item_id", "label").join(e.select(F.col("vec_id").alias("doc_id"), "label"), "label").filter("item_id <> doc_id").select("item_id", "doc_id")
    return evaluation.ranking_metrics(dense_hits(t), rel, "item_id", "doc_id", 10)


@query("recall_mrr_ndcg", f"WITH {METRICS} SELECT item_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m")
def _(t):
    return metrics(t).select("item_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


@query("metric_by_class_rollup", f"WITH {METRICS} SELECT label, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS n, CAST(grouping(label) AS INTEGER) AS is_total FROM m JOIN embeddings ON vec_id = item_id GROUP BY ROLLUP (label)")
def _(t):
    return evaluation.by_class(metrics(t).join(t.embeddings.select(F.col("vec_id").alias("item_id"), "label"), "item_id"), "label", ["recall", "mrr", "ndcg"])


@query("fusion_shootout", f"WITH {CH}, {', '.join(fused_sql(k) for k in FUSED)}, {REL}, f AS ({' UNION ALL '.join(f'SELECT {chr(39)}{k}{chr(39)} AS strategy, * FROM f_{k}' for k in FUSED)}) SELECT strategy, count(*) AS n_hits, count(DISTINCT f.item_id) AS n_questions, round(avg(1.0 / rank), 6) AS mean_reciprocal FROM f JOIN rel ON f.item_id = rel.item_id AND f.doc_id = rel.doc_id WHERE rank <= 10 GROUP BY 1")
def _(t):
    e = t.embeddings.select("vec_id", "label")
    rel = t.benchmark.select("item_id").join(e, F.col("item_id") == F.col("vec_id")).select("item_id", "label").join(e.select(F.col("vec_id").alias("doc_id"), "label"), "label").filter("item_id <> doc_id").select("item_id", "doc_id")
    c, out = frame(t), None
    for kind in fusion.STRATEGIES:
        f = fusion.fuse(c, kind, "item_id", "doc_id", 10).withColumn("strategy", F.lit(kind))
        out = f if out is None else out.unionByName(f)
    return out.join(rel, ["item_id", "doc_id"]).groupBy("strategy").agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("item_id").alias("n_questions"), F.round(F.avg(1 / F.col("rank")), 6).alias("mean_reciprocal"))
