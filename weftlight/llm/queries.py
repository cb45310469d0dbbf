"""The queries op1 to op13 and the pipeline, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlight.llm.common import tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlight.llm.bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), digests=True)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlight.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlight.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlight.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlight.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlight.llm.mixing import score

    return score(table(spark, sf_dir, "documents"))


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlight.llm.records import token_records

    return token_records(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlight.llm.simhash import near_duplicate_components

    return near_duplicate_components(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlight.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlight.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlight.llm.audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlight.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlight.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_html": op2_html,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_context_mixing": op6_context_mixing,
    "op7_records": op7_records,
    "op8_simhash": op8_simhash,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_top_k": op10_top_k,
    "op11_filter_audit": op11_filter_audit,
    "op12_quality": op12_quality,
    "op13_phrases": op13_phrases,
}
ORACLE_SQL: dict[str, str] = {
    # every order is walked step by step: rows that fail none of the filters before
    "op11_filter_audit": r"""
        WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                          [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
             f AS (SELECT doc_id, part, CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
                          + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT)
                          + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
                          + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS mask FROM w),
             l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
             m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (l.good) AS good, count(*) FILTER (l.toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
             c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
             p AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order, [a.bit, b.bit, d.bit, e.bit, g.bit] AS bits
                   FROM c a, c b, c d, c e, c g WHERE a.bit + b.bit + d.bit + e.bit + g.bit = 31 AND len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
             s AS (SELECT filter_order, CAST(step AS INT) AS step, CAST(bits[step] AS INT) AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM p, range(1, 6) r(step)),
             t AS (SELECT part, filter_order, step, own,
                          coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS kept,
                          coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS removed,
                          coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0) AS redundant,
                          coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
                          coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS good_lost,
                          coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS toxic_lost FROM m, s GROUP BY 1, 2, 3, 4)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM t
    """,
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op10_top_k": """
        WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
             v AS (SELECT vec_id, i, CAST(floor(1024 * x) AS BIGINT) AS x FROM p
                   WHERE vec_id NOT IN (SELECT vec_id FROM p WHERE x IS NULL OR NOT isfinite(x))),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    # every run of one to four words is counted as a string
    "op13_phrases": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
             p AS (SELECT row_number() OVER () AS p, lang, string_split_regex(piece, '[ \t]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
             t AS (SELECT p, lang, word, i FROM (SELECT p, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM p) WHERE word <> ''),
             n AS (SELECT lang, count(*) AS n FROM t GROUP BY 1),
             r AS (SELECT lang, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4 FROM t WINDOW o AS (PARTITION BY p ORDER BY i)),
             g AS (SELECT lang, 1 AS k, word AS g FROM r UNION ALL SELECT lang, 2, word || ' ' || w2 FROM r WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, word || ' ' || w2 || ' ' || w3 FROM r WHERE w3 IS NOT NULL
                   UNION ALL SELECT lang, 4, word || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM r WHERE w4 IS NOT NULL),
             f AS MATERIALIZED (SELECT lang, k, g, string_split(g, ' ') AS w, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
             h AS (SELECT lang, g, f, k, CAST(j AS INT) AS j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS rest FROM f, range(1, 4) s(j) WHERE k > j),
             c AS (SELECT h.lang, h.k, h.g, h.f AS a, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * h.f // (x.f + y.f) AS BIGINT) AS score, j
                   FROM h JOIN f x ON x.lang = h.lang AND x.g = h.head JOIN f y ON y.lang = h.lang AND y.g = h.rest),
             b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS o FROM c) WHERE o = 1),
             s AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS g, f FROM f, range(2, 4) t(m), range(1, 4) u(i) WHERE k > m AND i + m - 1 <= k),
             x AS (SELECT lang, g, max(f) AS longer FROM s GROUP BY 1, 2),
             k AS (SELECT b.lang, b.g AS phrase, a, l, r, score FROM b LEFT JOIN x ON x.lang = b.lang AND x.g = b.g WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) JOIN n USING (lang) WHERE rank <= 2000
    """,
}
