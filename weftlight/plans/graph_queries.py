"""Queries over key relationships, events and sales: graph, memory, streams in batch form, relational completeness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftlight.operators import graph, graph_retrieval, planning, resolution, selection
from weftlight.plans.registry import query
from weftlight.plans.storage_queries import SUPERSEDED
from weftlight.streaming import streams

EDGES = """edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'has_nation' AS kind, 1.0::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'has_customer', 0.9::DOUBLE FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'has_supplier', 0.8::DOUBLE FROM supplier)"""


def edges(t):
    e = lambda df, a, x, b, y, kind, c: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(kind).alias("kind"), F.lit(c).alias("confidence"))
    return e(t.nation, "r", "n_regionkey", "n", "n_nationkey", "has_nation", 1.0).unionByName(e(t.customer, "n", "c_nationkey", "c", "c_custkey", "has_customer", 0.9)).unionByName(e(t.supplier, "n", "s_nationkey", "s", "s_suppkey", "has_supplier", 0.8))


def regions(t):
    return t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("seed"))


@query("graph_nodes_edges", f"WITH {EDGES} SELECT kind, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM edges GROUP BY 1")
def _(t):
    return edges(t).groupBy("kind").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


@query("graph_khop_scores", f"""WITH RECURSIVE {EDGES}, hop AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, 0 AS hop, 1.0::DOUBLE AS score FROM region UNION ALL SELECT seed, dst, hop + 1, confidence * pow(0.8, hop + 1) FROM hop JOIN edges ON node = src WHERE hop < 3)
  SELECT seed, node, CAST(min(hop) AS INTEGER) AS hop, round(max(score), 6) AS score FROM hop GROUP BY 1, 2""")
def _(t):
    return graph.k_hop(edges(t), regions(t), 3).withColumn("score", F.round("score", 6))


@query("graph_khop_both_ways")
def _(t):
    return graph.k_hop(edges(t), regions(t), 2, both_ways=True)


@query("graph_paths", f"WITH RECURSIVE {EDGES}, p AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, 0 AS hop, ['r' || r_regionkey] AS path FROM region UNION ALL SELECT seed, dst, hop + 1, list_append(path, dst) FROM p JOIN edges ON node = src WHERE hop < 2) SELECT seed, node, CAST(hop AS INTEGER) AS hop, path FROM p")
def _(t):
    return graph.paths(edges(t), regions(t), 2)


@query("entity_context", f"WITH {EDGES} SELECT id, sum(o) AS n_out, sum(i) AS n_in, count(DISTINCT kind) AS kinds FROM (SELECT src AS id, 1 AS o, 0 AS i, kind FROM edges UNION ALL SELECT dst, 0, 1, kind FROM edges) GROUP BY 1")
def _(t):
    return graph.context(edges(t))


@query("edge_merge", "SELECT o_custkey AS src, l_suppkey AS dst, 'bought_from' AS kind, max(l_discount) AS confidence, count(*) AS n_records FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def _(t):
    e = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("bought_from").alias("kind"), F.col("l_discount").alias("confidence"))
    return graph.merge_edges(e)


@query("node_merge", "SELECT p_brand AS id, sum(p_size) AS mentions, max(p_retailprice) AS confidence, arg_min(p_name, (-length(p_name), p_name)) AS description FROM part GROUP BY 1")
def _(t):
    return graph.merge_nodes(t.part.select(F.col("p_brand").alias("id"), F.col("p_size").alias("mentions"), F.col("p_retailprice").alias("confidence"), F.col("p_name").alias("description")))


@query("temporal_edges", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1997-01-01'")
def _(t):
    e = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("valid_to"))
    return graph.temporal_edges(e, "1996-01-01", "1997-01-01").select("o_orderkey", "o_custkey")


# ---- memory: events are records, users subjects, types layers --------------------------------------------------------------


@query("memory_filter", "SELECT event_id, event_type AS layer, value AS confidence FROM events WHERE event_type IN ('purchase', 'signup') AND value >= 20 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def _(t):
    return t.events.filter(F.col("event_type").isin("purchase", "signup") & (F.col("value") >= 20) & F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))).select("event_id", F.col("event_type").alias("layer"), F.col("value").alias("confidence"))


@query("memory_tag_any", "SELECT DISTINCT user_id FROM events WHERE event_type IN ('error', 'signup')")
def _(t):
    users = t.events.select("user_id").distinct()
    return users.join(t.events.filter(F.col("event_type").isin("error", "signup")).select("user_id"), "user_id", "left_semi")


@query("memory_tag_all", "SELECT user_id FROM events WHERE event_type IN ('error', 'signup', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def _(t):
    return t.events.filter(F.col("event_type").isin("error", "signup", "purchase")).groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).filter("n = 3").select("user_id")


@query("memory_layer_cap", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, ts DESC, event_id) AS r FROM events) WHERE r <= 100")
def _(t):
    return selection.layer_cap(t.events, "event_type", 100, [F.col("value").desc_nulls_last(), F.col("ts").desc(), F.col("event_id")]).select("event_id", "event_type")


@query("memory_stats_grouping_sets", "SELECT event_type, user_id, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def _(t):
    return t.sql("SELECT event_type, user_id, count(*) AS n, round(avg(value), 4) AS mean FROM {events} GROUP BY GROUPING SETS ((event_type), (user_id), ())", "events")


@query("memory_supersession", f"WITH RECURSIVE {SUPERSEDED} SELECT event_id, live FROM l")
def _(t):
    return selection.supersede(t.events.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").alias("object")), ["user_id", "event_type"], "ts", "object", "value", "event_id").select("event_id", "live")


@query("delta_sequence", "SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS sequence, lead(ts) OVER w AS valid_to, lead(1) OVER w IS NULL AS is_current FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    return graph.change_log(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").drop("ts")


@query("claim_versions_current", "SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value, count(*) AS versions FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count(F.lit(1)).alias("versions"))


@query("delta_retention", "SELECT event_id FROM events WHERE event_type = 'purchase' OR ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def _(t):
    last = t.events.agg(F.max("ts").alias("last"))
    return t.events.crossJoin(F.broadcast(last)).filter((F.col("event_type") == "purchase") | (F.col("ts") >= F.col("last") - F.expr("interval 10 days"))).select("event_id")


# ---- streams in batch form ---------------------------------------------------------------------------------------------------


@query("run_sessions", """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM s)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def _(t):
    return streams.sessions(t.events, "user_id", "ts", "6 hours")


@query("run_summary", "SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 4) AS tokens, count(*) >= 60 AS over_ceiling, min(ts) AS started, max(ts) AS ended FROM events GROUP BY 1")
def _(t):
    n = F.count(F.lit(1))
    return t.events.groupBy("user_id").agg(n.alias("calls"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.sum("value"), 4).alias("tokens"), (n >= 60).alias("over_ceiling"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("quota_tumbling", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    return streams.tumbling(t.events, "user_id", "ts", "1 day", "value").withColumn("total", F.round("total", 4))


@query("quota_first_use")
def _(t):
    return streams.quota(t.events.withColumn("value", F.coalesce("value", F.lit(0.0))), "user_id", "ts", "value", "event_id", 86400.0, 100.0)


@query("rate_limit_sliding", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS recent FROM events")
def _(t):
    return streams.within_last(t.events, "event_type", "ts", 60).select("event_id", "recent")


@query("rate_limit_exact")
def _(t):
    return streams.rate_limit(t.events, "event_type", "ts", "event_id", (600, 3), (60, 2))


@query("sliding_windows", "SELECT event_type, CAST(start AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2")
def _(t):
    return streams.sliding(t.events, "event_type", "ts", "2 hours", "1 hour")


@query("provider_health", """WITH c AS (SELECT *, CASE WHEN event_type = 'error' THEN ts + INTERVAL 15 SECOND END AS u FROM events), o AS (SELECT *, max(u) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS out_until FROM c) SELECT event_id, out_until, out_until IS NULL OR ts >= out_until AS available FROM o""")
def _(t):
    e = t.events.withColumn("kind", F.when(F.col("event_type") == "error", "server_error"))
    return streams.health(e, "user_id", "ts", "kind", "event_id").select("event_id", "out_until", "available")


@query("marginal_gain", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, json_extract_string(props, '$.k') AS k FROM events), f AS (SELECT user_id, k, min(day) AS day FROM e WHERE k IS NOT NULL GROUP BY 1, 2), st AS (SELECT user_id, day, count(DISTINCT k) AS found FROM e GROUP BY 1, 2), n AS (SELECT user_id, day, count(*) AS new FROM f GROUP BY 1, 2),
  g AS (SELECT user_id, day, found, coalesce(new, 0) AS new, coalesce(sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known FROM st LEFT JOIN n USING (user_id, day))
  SELECT user_id, day, found, new, CAST(known AS BIGINT) AS known, round(CASE WHEN known > 0 THEN new / known WHEN new > 0 THEN 1 ELSE 0 END, 6) AS gain FROM g""")
def _(t):
    e = t.events.select("user_id", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").alias("k"))
    return gains(e).select("user_id", "day", "found", "new", "known", F.round("gain", 6).alias("gain"))


def gains(e):
    return streams.gain(e.filter("k is not null"), "user_id", "day", "k").unionByName(e.limit(0).select("user_id", "day", F.lit(0).cast("long").alias("found"), F.lit(0).cast("long").alias("new"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("gain"), F.lit(0).alias("empty_run")))


@query("consecutive_empty", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL), f AS (SELECT user_id, k, min(day) AS day FROM e GROUP BY 1, 2), n AS (SELECT DISTINCT user_id, day FROM f),
  s AS (SELECT d.user_id, d.day, n.day IS NOT NULL AS new FROM (SELECT DISTINCT user_id, day FROM e) d LEFT JOIN n ON n.user_id = d.user_id AND n.day = d.day), i AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY day) AS island FROM s)
  SELECT user_id, day, CAST(count(*) FILTER (NOT new) OVER (PARTITION BY user_id, island ORDER BY day) AS INTEGER) AS empty_run FROM i""")
def _(t):
    return gains(t.events.select("user_id", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").alias("k"))).select("user_id", "day", "empty_run")


@query("stop_condition")
def _(t):
    g = gains(t.events.select("user_id", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").alias("k")))
    w = Window.partitionBy("user_id").orderBy("day")
    s = g.withColumn("iteration", F.row_number().over(w)).withColumns({"max_iterations": F.lit(20), "coverage": F.lit(0.5), "contradictions": F.lit(0), "history": F.col("iteration"), "empty_runs": F.col("empty_run")})
    return s.select("user_id", "day", planning.stop_condition(s).alias("stop"))


@query("asof_latest_event", "SELECT a.event_id, b.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = t.events.filter(F.col("event_type").isin("purchase", "view"))
    seen = e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return seen.filter("event_type = 'purchase'").select("event_id", "view_id")


# ---- relational completeness: one text for both engines -----------------------------------------------------------------------

SAME = {
    "count_tables": "SELECT 'documents' AS name, count(*) AS n FROM {documents} UNION ALL SELECT 'pages', count(*) FROM {pages} UNION ALL SELECT 'embeddings', count(*) FROM {embeddings} UNION ALL SELECT 'labels', count(*) FROM {labels}",
    "rollup_sales": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube_segments": "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "topn_per_group": "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM {lineitem}) WHERE r <= 3",
    "window_frames": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rnk, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, round(percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey), 6) AS share FROM {orders}",
    "semi_join": "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "anti_join": "SELECT c_custkey, c_nationkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)",
    "set_intersect": "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O'",
    "set_except_all": "SELECT o_custkey AS k FROM {orders} EXCEPT ALL SELECT c_custkey FROM {customer}",
    "set_intersect_all": "SELECT l_suppkey AS k FROM {lineitem} INTERSECT ALL SELECT s_suppkey FROM {supplier}",
    "scalar_subquery": "SELECT p_partkey FROM {part} WHERE p_retailprice > (SELECT avg(p_retailprice) FROM {part})",
    "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1",
    "conditional_sums": "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS p FROM {orders} GROUP BY 1",
    "distinct_counts": "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM {events} GROUP BY 1",
    "pages_sorted": "SELECT doc_id, source, n_chars FROM {documents} ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20",
    "labels_by_source": "SELECT source, count(*) AS n, sum(quality) AS good, sum(toxic) AS toxic FROM {documents} JOIN {labels} USING (doc_id) GROUP BY 1",
    "source_yield": "SELECT source, count(DISTINCT doc_id) AS docs, sum(n_chars) AS chars FROM {documents} GROUP BY 1",
    "recursive_region_tree": "SELECT r_name, n_name, count(c_custkey) AS customers FROM {region} JOIN {nation} ON r_regionkey = n_regionkey LEFT JOIN {customer} ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "percentiles": "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS median, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6) AS p90 FROM {events} GROUP BY 1",
    "variance": "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 4) AS sd, round(corr(o_totalprice, o_orderkey), 6) AS r FROM {orders} GROUP BY 1",
}
_NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
for _name, _sql in SAME.items():
    _used = [n for n in _NAMES if "{" + n + "}" in _sql]
    _plain = _sql
    for _n in _used:
        _plain = _plain.replace("{" + _n + "}", _n)
    query(_name, _plain)(lambda t, sql=_sql, used=_used: t.sql(sql, *used))


@query("pivot_events", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").pivot("event_type", ["click", "view"]).count().na.fill(0, ["click", "view"]).join(t.events.filter(F.col("event_type").isin("click", "view")).select("user_id"), "user_id", "left_semi")


@query("unpivot_labels", "SELECT doc_id, 'quality' AS metric, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def _(t):
    return t.labels.unpivot("doc_id", ["quality", "toxic"], "metric", "value")


@query("approx_distinct")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median_price"))


@query("range_join", "SELECT o_orderkey, count(*) AS n FROM orders JOIN events ON ts >= o_orderdate + INTERVAL 25 YEAR AND ts < o_orderdate + INTERVAL 25 YEAR + INTERVAL 1 HOUR GROUP BY 1")
def _(t):
    o = t.orders.select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 25 years")).alias("a")).withColumn("b", F.col("a") + F.expr("interval 1 hour"))
    hour = lambda c: F.date_trunc("hour", c)
    # both sides meet in the hours that an interval touches, so the range predicate follows an equi-join
    left = o.select("*", F.explode(F.sequence(hour("a"), hour("b"), F.expr("interval 1 hour"))).alias("h"))
    return left.join(t.events.select("ts", hour("ts").alias("h")), "h").filter("ts >= a and ts < b").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


# ---- export, traces, promotion -----------------------------------------------------------------------------------------------


@query("graph_export", f"WITH {EDGES}, n AS (SELECT 'r' || r_regionkey AS id, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier) SELECT src, dst, kind, a.label AS src_label, substring(b.label, 1, 24) AS dst_label FROM edges JOIN n a ON src = a.id JOIN n b ON dst = b.id")
def _(t):
    node = lambda df, p, k, name: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.col(name).alias("label"))
    n = node(t.region, "r", "r_regionkey", "r_name").unionByName(node(t.nation, "n", "n_nationkey", "n_name")).unionByName(node(t.supplier, "s", "s_suppkey", "s_name"))
    # edges with an end that has no node go
    e = edges(t).join(n.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src").join(n.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")
    return e.select("src", "dst", "kind", "src_label", F.substring("dst_label", 1, 24).alias("dst_label"))


@query("reasoning_trace", "WITH c AS (SELECT *, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn AS src, next_turn AS dst, CASE WHEN role = 'user' AND next_role = 'assistant' THEN 'answered_by' WHEN role = 'assistant' AND next_role = 'user' THEN 'followed_by' ELSE 'precedes' END AS label FROM c WHERE next_turn IS NOT NULL")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.select("conv_id", "turn", "role", F.lead("turn").over(w).alias("dst"), F.lead("role").over(w).alias("r")).filter("dst is not null")
    label = F.when((F.col("role") == "user") & (F.col("r") == "assistant"), "answered_by").when((F.col("role") == "assistant") & (F.col("r") == "user"), "followed_by").otherwise("precedes")
    return c.select("conv_id", F.col("turn").alias("src"), "dst", label.alias("label"))


@query("node_timings", "SELECT event_id, date_diff('second', lag(ts) OVER w, ts) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = lambda c: F.unix_seconds(F.date_trunc("second", c).cast("timestamp"))
    return t.events.select("event_id", (at(F.col("ts")) - F.lag(at(F.col("ts"))).over(w)).alias("seconds"))


@query("memory_promotion", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value >= 20 AND props IS NOT NULL AND event_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.events.filter("event_type = 'purchase' AND value >= 20 AND props IS NOT NULL").join(t.labels.select(F.col("doc_id").alias("event_id")), "event_id", "left_anti").select("event_id", "user_id", "value")


@query("priority_limits", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) WHERE r <= CASE WHEN s_acctbal > 5000 THEN 10 WHEN s_acctbal > 0 THEN 7 ELSE 5 END")
def _(t):
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_acctbal") > 5000, "high").when(F.col("s_acctbal") > 0, "medium").otherwise("low").alias("p"))
    w = Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    r = t.lineitem.join(s, "l_suppkey").withColumn("r", F.row_number().over(w))
    return r.filter(F.col("r") <= planning.results_per_need(F.col("p"), 5)).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("gap_dedupe", "SELECT event_type, lower(json_extract_string(props, '$.k')) AS k, min(event_id) AS first FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def _(t):
    k = F.lower(F.get_json_object("props", "$.k"))
    return t.events.filter(k.isNotNull()).groupBy("event_type", k.alias("k")).agg(F.min("event_id").alias("first"))


@query("entity_cooccurrence", "WITH p AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT x.b AS a, y.b AS b, count(*) AS n FROM p x JOIN p y ON x.o = y.o AND x.b < y.b GROUP BY 1, 2")
def _(t):
    p = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o"), F.col("p_brand").alias("b")).distinct()
    return p.withColumnRenamed("b", "a").join(p, "o").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("hash_checksums", "SELECT conv_id, turn, sha256(text) AS sha, md5(text) AS md FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


@query("entity_resolution", """WITH RECURSIVE e AS (SELECT user_id, json_extract_string(props, '$.k') AS k, event_id FROM events WHERE event_type = 'signup' AND value >= 22),
  g AS (SELECT DISTINCT 'u' || user_id AS a, 'k' || k AS b FROM e WHERE k IS NOT NULL), s AS (SELECT a, b FROM g UNION SELECT b, a FROM g), r AS (SELECT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen),
  f AS (SELECT seen AS name, min(event_id) AS first FROM (SELECT 'u' || user_id AS seen, event_id FROM e WHERE k IS NOT NULL) GROUP BY 1)
  SELECT r.node AS name, min(f.first) AS id FROM r JOIN f ON f.name = r.seen GROUP BY 1""")
def _(t):
    """Users as entities and property values as their aliases, in two batches by time; ids are the first event's."""
    rows = t.events.filter("event_type = 'signup' and value >= 22").withColumn("k", F.get_json_object("props", "$.k")).filter("k is not null")
    batch = lambda part: rows.filter(part).select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.array(F.concat(F.lit("k"), "k")).alias("aliases"))
    index, _ = resolution.resolve(None, batch("dayofmonth(ts) <= 15"))
    return resolution.resolve(index, batch("dayofmonth(ts) > 15"))[0]


@query("graph_evidence", """SELECT region, chunk, max(score) AS score FROM (SELECT n_regionkey AS region, 'n' || n_nationkey AS chunk, 1.0::DOUBLE AS score FROM nation
  UNION ALL SELECT n_regionkey, 'c' || c_custkey, 0.9 * 0.8 FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, 's' || s_suppkey, 0.8 * 0.8 FROM nation JOIN supplier ON s_nationkey = n_nationkey
  UNION ALL SELECT r_regionkey, r_name, 0.5 FROM region UNION ALL SELECT n_regionkey, n_name, 0.5 FROM nation) GROUP BY 1, 2""")
def _(t):
    """What two steps from every region find: edges' chunks by their far end, nodes' chunks by their names."""
    e = edges(t).withColumn("chunk", F.col("dst"))
    names = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_name").alias("chunk")).unionByName(t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.col("n_name").alias("chunk")))
    seeds = t.region.select(F.col("r_regionkey").alias("region"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph_retrieval.evidence(e, names, seeds, "region", 2, kinds=("has_nation", "has_customer", "has_supplier"))
