"""Frames of the queries over plans, claims and contradictions: questions about parts and short reports on their sales.

One SQL text makes each frame for both engines; `{name}` marks a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

TITLE = "upper(substring(p_name, 1, 1)) || substring(p_name, 2, instr(p_name, ' ') - 1) || upper(substring(p_name, instr(p_name, ' ') + 1, 1)) || substring(p_name, instr(p_name, ' ') + 2)"

#: (question, q_no, title, text): a question of one of four kinds about every name of a part.
QUESTIONS = f"""names AS (SELECT p_name AS question, {TITLE} AS title, CAST(row_number() OVER (ORDER BY p_name) AS INT) AS q_no FROM (SELECT DISTINCT p_name FROM {{part}}) d),
  asked AS (SELECT question, q_no, title, CASE q_no % 4 WHEN 0 THEN 'Do the ' || title || ' revenue figures conflict with the legacy numbers of Northern Depot?'
    WHEN 1 THEN 'Which suppliers are downstream of the ' || title || ' plant via Northern Depot?' WHEN 2 THEN 'Assess the ' || title || ' sales margin; evaluate Northern Depot capacity and explain the Southern Depot growth.'
    ELSE 'How many ' || title || ' units did Northern Depot ship?' END AS text FROM names)"""

#: (question, q_no, rank, chunk_id, doc_id, source, score, year, kind, text): six reports on the dearest sales of each part's name.
REPORTS = f"""{QUESTIONS},
  ranked AS (SELECT p.p_name AS question, l.*, CAST(row_number() OVER (PARTITION BY p.p_name ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INT) AS rank FROM {{lineitem}} l JOIN {{part}} p ON l_partkey = p_partkey),
  reports AS (SELECT r.question, q_no, rank, q_no * 10 + rank AS chunk_id, l_orderkey AS doc_id, l_suppkey AS source, round(l_discount * 10, 4) AS score, year(l_shipdate) + 25 AS year, l_returnflag || l_linestatus AS kind,
    title || CASE l_linenumber % 3 WHEN 0 THEN ' revenue' WHEN 1 THEN ' sales' ELSE ' output' END || ' was $' || CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS VARCHAR(20)) || ' million in ' || CAST(year(l_shipdate) + 25 AS VARCHAR(4)) || '. '
    || CASE l_returnflag WHEN 'A' THEN 'The ' || title || ' plant capacity is safe and its production will rise in Q' || CAST(quarter(l_shipdate) AS VARCHAR(1)) || '. ' WHEN 'N' THEN 'The ' || title || ' plant capacity is not safe and its production will fall. ' ELSE 'However, these figures are not audited and an older note is superseded. ' END
    || CASE l_linestatus WHEN 'F' THEN 'About ' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR(20)) || ' employees worked with the Northern Depot.' ELSE 'Utilization reached ' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR(20)) || '% at the Southern Depot as of ' || CAST(year(l_shipdate) + 25 AS VARCHAR(4)) || '.' END AS text
    FROM ranked r JOIN names n ON n.question = r.question WHERE rank <= 6)"""


def plain(text: str) -> str:
    """The frame for an engine that knows the tables by name."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def frame(t, text: str, name: str) -> DataFrame:
    return t.sql(f"WITH {text} SELECT * FROM {name}", *dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def questions(t) -> DataFrame:
    return t.kept("questions", lambda: frame(t, QUESTIONS, "asked"))


def reports(t) -> DataFrame:
    """Kept: all sales are ranked for it, which every use in a plan would do again."""
    return t.kept("reports", lambda: frame(t, REPORTS, "reports"))
