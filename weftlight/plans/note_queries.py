"""Queries of heading scopes, sections and insertion. Documents become notes: the shorter a line, the higher a heading it is."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlight.operators import headings
from weftlight.plans.registry import query

MARKED = "array_to_string([CASE WHEN len(x) BETWEEN 1 AND 15 THEN '# ' || x WHEN len(x) BETWEEN 16 AND 40 THEN '## ' || x WHEN len(x) BETWEEN 41 AND 70 THEN '### ' || x ELSE x END FOR x IN string_split(coalesce(text, ''), chr(10))], chr(10))"
LINES = f"""note AS (SELECT doc_id, {MARKED} AS text FROM documents), every AS (SELECT doc_id, CAST(at_ - 1 AS INTEGER) AS n, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at_ FROM note)),
  ln AS (SELECT *, len(regexp_extract(line, '^(#{{1,3}}) ', 1)) AS lv FROM every WHERE line <> ''), hd AS (SELECT doc_id, n, CAST(lv AS INTEGER) AS level, trim(substr(line, lv + 1)) AS title FROM ln WHERE lv > 0)"""


def notes(t):
    size = lambda x: F.length(x)
    mark = lambda x: F.when(size(x).between(1, 15), F.concat(F.lit("# "), x)).when(size(x).between(16, 40), F.concat(F.lit("## "), x)).when(size(x).between(41, 70), F.concat(F.lit("### "), x)).otherwise(x)
    return t.documents.select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), mark), "\n").alias("text"))


@query("heading_scopes", f"""WITH {LINES} SELECT doc_id, n AS line, level, title, (SELECT min(o.n) FROM hd o WHERE o.doc_id = hd.doc_id AND o.n > hd.n AND o.level <= hd.level) AS ends FROM hd""")
def _(t):
    return headings.scopes(headings.marked_lines(notes(t))).withColumnRenamed("at", "line")


@query("heading_sections", f"""WITH {LINES}, o AS (SELECT doc_id, n, title, level, coalesce((SELECT min(o.n) FROM hd o WHERE o.doc_id = hd.doc_id AND o.n > hd.n AND o.level <= hd.level), 1000000000) AS ends FROM hd),
  p AS (SELECT ln.doc_id, ln.n, any_value(ln.line) AS line, string_agg(o.title, ' > ' ORDER BY o.n) AS path FROM ln LEFT JOIN o ON o.doc_id = ln.doc_id AND o.n < ln.n AND o.ends > ln.n WHERE ln.lv = 0 GROUP BY 1, 2),
  c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(path) OVER w IS DISTINCT FROM path THEN 1 ELSE 0 END AS turn FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY n)), s AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM c)
  SELECT doc_id, CAST(section AS BIGINT) AS section, any_value(path) AS path, string_agg(line, chr(10) ORDER BY n) AS text FROM s GROUP BY 1, 2""")
def _(t):
    return headings.sections(headings.marked_lines(notes(t)))


@query("note_insertion", f"""WITH {LINES}, w AS (SELECT doc_id, arg_max(title, n) AS wanted FROM hd WHERE level = 2 GROUP BY 1), g AS (SELECT note.doc_id, note.text, coalesce(wanted, 'Notes') AS wanted FROM note LEFT JOIN w USING (doc_id)),
  x AS (SELECT g.doc_id, min(n) AS own, arg_min(level, n) AS lv FROM g JOIN hd ON hd.doc_id = g.doc_id AND lower(hd.title) = lower(g.wanted) GROUP BY 1), e AS (SELECT x.doc_id, x.own, min(hd.n) AS ends FROM x LEFT JOIN hd ON hd.doc_id = x.doc_id AND hd.n > x.own AND hd.level <= x.lv GROUP BY 1, 2),
  raw AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM note)),
  b AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY n) FILTER (ends IS NULL OR n < ends) AS head, string_agg(line, chr(10) ORDER BY n) FILTER (n >= ends) AS rest FROM e JOIN raw USING (doc_id) GROUP BY 1)
  SELECT g.doc_id, CASE WHEN b.doc_id IS NULL THEN rtrim(g.text, ' ' || chr(10)) || chr(10) || chr(10) || '## ' || wanted || chr(10) || chr(10) || 'Added.' || chr(10)
    ELSE rtrim(head, ' ' || chr(10)) || chr(10) || chr(10) || 'Added.' || chr(10) || chr(10) || ltrim(coalesce(rest, ''), chr(10)) END AS text FROM g LEFT JOIN b USING (doc_id)""")
def _(t):
    """A line added to the last second-level heading's title, wherever that title comes first; to a new one where there is none."""
    own = notes(t)
    wanted = headings.marked_lines(own).filter("level = 2").groupBy("doc_id").agg(F.max_by("title", "at").alias("wanted"))
    return own.join(wanted, "doc_id", "left").select("doc_id", headings.inserted(F.col("text"), F.lit(" Added.\n"), F.coalesce("wanted", F.lit("Notes"))).alias("text"))
