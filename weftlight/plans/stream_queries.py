"""Queries of the health machine over events, in its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlight.plans.registry import query
from weftlight.streaming import health

#: What event types say about the provider (property k) and the model (user) that they concern. Cooldowns are in hours here.
CODES = {"error": "PROVIDER_UNAVAILABLE", "signup": "RATE_LIMIT_ERROR", "purchase": "QUOTA_EXHAUSTED"}

CHANGED = """c AS (SELECT event_id, ts, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
  o AS (SELECT CASE WHEN event_type = 'error' OR user_id IS NULL THEN k ELSE k || '/' || user_id END AS entity, ts AS moment, event_id AS ident, event_type <> 'view' AS failed,
               CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'signup' THEN 'rate_limited' WHEN 'purchase' THEN 'quota_exhausted' ELSE 'healthy' END AS status,
               CASE event_type WHEN 'error' THEN 15 WHEN 'signup' THEN 10 WHEN 'purchase' THEN 30 END * INTERVAL 1 HOUR AS rest FROM c WHERE event_type <> 'click'),
  s AS (SELECT *, moment + rest AS until, lead(moment) OVER w AS after, lag(moment + rest) OVER w AS was, CASE WHEN NOT failed OR moment - lag(moment) OVER w > INTERVAL 48 HOUR THEN 1 ELSE 0 END AS cut FROM o WINDOW w AS (PARTITION BY entity ORDER BY moment, ident)),
  r AS (SELECT *, sum(cut) OVER (PARTITION BY entity ORDER BY moment, ident) AS run FROM s),
  f AS (SELECT *, CAST(count(*) FILTER (failed) OVER (PARTITION BY entity, run ORDER BY moment, ident) AS INTEGER) AS failures FROM r),
  ch AS (SELECT entity, moment, ident, status, until, failures FROM f WHERE failed OR was > moment UNION ALL SELECT entity, until, NULL, 'healthy', NULL, failures FROM f WHERE failed AND (after IS NULL OR until <= after))"""


def calls(t):
    e = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    code = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])[F.col("event_type")]
    return e.withColumns({"code": code, "scope": F.when(F.col("event_type") == "error", "provider").otherwise("model")})


def changes(t):
    seen = health.outcomes(calls(t).filter("event_type <> 'click'"), "k", "user_id", "ts", "event_id", "code", "scope", unit=3600.0)
    return health.health_changes(seen, idle=48 * 3600.0)


@query("provider_health_changes", f"WITH {CHANGED} SELECT entity, moment AS \"at\", ident, status, until, failures FROM ch")
def _(t):
    return changes(t).select("entity", F.col("at").cast("timestamp_ntz").alias("at"), "ident", "status", F.col("until").cast("timestamp_ntz").alias("until"), "failures")


@query("provider_routing", f"""WITH {CHANGED}, q AS (SELECT event_id, ts, unnest([0, 1]) AS turn, unnest([k, k || '/' || user_id]) AS entity FROM c WHERE event_type = 'click'),
  m AS (SELECT event_id, turn, ts, arg_max(status, (moment, coalesce(ident, -1))) AS status, arg_max(coalesce(until, TIMESTAMP '1970-01-01'), (moment, coalesce(ident, -1))) AS until FROM q JOIN ch ON ch.entity = q.entity AND ch.moment <= q.ts GROUP BY 1, 2, 3),
  b AS (SELECT event_id, arg_min(status, turn) AS status, arg_min(date_diff('microsecond', ts, until) / 1e6, turn) AS remaining FROM m WHERE until > ts GROUP BY 1)
  SELECT c.event_id, b.event_id IS NOT NULL AS blocked, CASE WHEN status IN ('quota_exhausted', 'rate_limited') THEN status WHEN status IS NOT NULL THEN 'unavailable' END AS reason, remaining FROM c LEFT JOIN b USING (event_id) WHERE event_type = 'click'""")
def _(t):
    return health.routing(calls(t).filter("event_type = 'click'"), changes(t), "k", "user_id", "ts", "event_id")
