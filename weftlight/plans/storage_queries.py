"""Queries of versioned tables, contiguous ids and interval joins. The stores they make lie in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from weftlight.operators.numbering import continued, numbered
from weftlight.plans.registry import query
from weftlight.plans.retrieval_queries import bm25_sql
from weftlight.sources import memory
from weftlight.sources.places import shared_folder
from weftlight.sources.segments import SegmentedIndex
from weftlight.sources.snapshots import Store
from weftlight.streaming.joining import interval_join


@query("contiguous_ids", "SELECT doc_id, source, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS n FROM documents")
def _(t):
    return numbered(t.documents.select("doc_id", "source"), "n", ["source", "doc_id"])


@query("ids_continue_from_max", """WITH d AS (SELECT doc_id, source, vec_id AS n FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
  SELECT doc_id, coalesce(n, (SELECT coalesce(max(n), 0) FROM d) + count(*) FILTER (n IS NULL) OVER (ORDER BY source NULLS FIRST, doc_id)) AS n FROM d""")
def _(t):
    known = t.documents.select("doc_id", "source").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("n")), "doc_id", "left")
    return continued(known, "n", ["source", "doc_id"]).select("doc_id", "n")


@query("interval_join_outer", """SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e
  LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.ts BETWEEN e.ts - INTERVAL 1 HOUR AND e.ts + INTERVAL 6 HOUR""")
def _(t):
    errors = t.events.filter("event_type = 'error'").select("user_id", "event_id", F.col("ts").alias("at"))
    bought = t.events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    return interval_join(errors, bought, "user_id", "at", "bought", 3600, 6 * 3600, outer=True).select("event_id", "purchase_id")


@query("versioned_ingest", """WITH d AS (SELECT doc_id, text, pmod AS part, min((pmod, doc_id)) OVER (PARTITION BY text) AS first FROM (SELECT *, doc_id % 3 AS pmod FROM documents)),
  k AS (SELECT doc_id, part, len(text) AS n_chars, len(string_split(text, chr(10))) AS n_chunks FROM d WHERE first = (part, doc_id))
  SELECT v AS version, count(*) AS documents, CAST(sum(n_chunks) AS BIGINT) AS chunks, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM k, range(1, 4) r(v) WHERE part < v GROUP BY 1""")
def _(t):
    """Three ingests of a third each, read at every version: documents and chunks of one version agree."""
    store = Store(t.spark, shared_folder(t.spark, "documents"))
    docs = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("checksum", F.sha2("text", 256))
    for i in range(3):
        part = docs.filter(F.pmod("doc_id", F.lit(3)) == i)
        memory.ingest(store, part, part.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line")), writer=("ingest", i))
    out = []
    for v in store.versions():
        at = store.manifest(v)
        d, c = store.read("documents", of=at), store.read("chunks", of=at)
        sizes = d.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("n_chars"), F.lit(v).cast("long").alias("version"))
        chunks = c.join(d.select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("chunks"), F.lit(v).cast("long").alias("version"))
        out.append(sizes.join(chunks, "version").select("version", "documents", "chunks", "n_chars"))
    return reduce(lambda a, b: a.unionByName(b), out)


#: Each key's records in time order: what stands, how often it was replaced, and whether the record was accepted.
SUPERSEDED = """e AS (SELECT event_id, ts, user_id, event_type, json_extract_string(props, '$.k') AS object, value AS c, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
  w AS (SELECT user_id, event_type, r, event_id, object AS so, c AS sc, 0 AS epoch, true AS ok FROM e WHERE r = 1 UNION ALL
    SELECT e.user_id, e.event_type, e.r, e.event_id, CASE WHEN coalesce(e.c >= w.sc, false) THEN e.object ELSE w.so END, CASE WHEN coalesce(e.c >= w.sc, false) THEN e.c ELSE w.sc END,
      w.epoch + CASE WHEN e.object IS DISTINCT FROM w.so AND coalesce(e.c >= w.sc, false) THEN 1 ELSE 0 END, e.object IS NOT DISTINCT FROM w.so OR coalesce(e.c >= w.sc, false)
    FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.r = w.r + 1),
  l AS (SELECT event_id, ok AND epoch = max(epoch) OVER (PARTITION BY user_id, event_type) AS live FROM w)"""


@query("memory_transactions", f"WITH RECURSIVE {SUPERSEDED} SELECT event_id, CASE WHEN live THEN 'memory' ELSE 'archive' END AS place FROM l")
def _(t):
    """Events as records, remembered in three commits by time; where each one is afterwards."""
    rows = t.events.filter("user_id is not null and event_type is not null").select(F.col("event_id").alias("id"), F.col("event_type").alias("layer"), F.col("user_id").alias("subject"), F.lit("is").alias("predicate"), F.get_json_object("props", "$.k").alias("value"), F.col("value").alias("confidence"), F.col("ts").alias("created"), F.array("event_type").alias("tags"))
    store = Store(t.spark, shared_folder(t.spark, "memory"))
    days = F.dayofmonth("created")
    for i, part in enumerate((days <= 10, (days > 10) & (days <= 20), days > 20)):
        memory.remember(store, rows.filter(part), cap=1 << 30, writer=("memory", i))
    at = store.manifest()
    return store.read("memory", of=at).select(F.col("id").alias("event_id"), F.lit("memory").alias("place")).unionByName(store.read("archive", of=at).select(F.col("id").alias("event_id"), F.lit("archive").alias("place")))


@query("segmented_bm25", f"""WITH kept AS (SELECT doc_id, text FROM documents WHERE source <> 'src3'), {bm25_sql('kept', 'doc_id', 'benchmark', 'item_id', 10)} SELECT item_id, doc_id, score, rank FROM lex10""")
def _(t):
    """An index of all documents from three segments, a source deleted from it, the segments of one tier merged; asked every question."""
    index = SegmentedIndex(Store(t.spark, shared_folder(t.spark, "index")))
    docs = t.documents.select("doc_id", "text")
    for i in range(3):
        index.append(docs.filter(F.pmod("doc_id", F.lit(3)) == i), writer=("build", i))
    index.delete(t.documents.filter("source = 'src3'").select("doc_id"))
    index.merge()
    return index.search(t.benchmark, "item_id", 10)
