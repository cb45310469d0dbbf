"""Contradictions between numeric claims, negations and validity periods; blocked on their keys, never all pairs of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlight.functions import text as X


def numeric_conflicts(claims: DataFrame, block: list[str], source: str, value: str, tolerance: float = 0.01, severity: float = 0.7) -> DataFrame:
    """Pairs a < b of one block from different sources whose values differ by more than the tolerance.

    Only the extremes of a (block, source) take part: if any two of its values conflict with another source's, an
    extreme does. So a block's pairs grow with its sources, not with its rows.
    """
    s = claims.groupBy(*block, source).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
    a, b = s.select(*block, *[F.col(c).alias(f"a_{c}") for c in (source, "low", "high")]), s.select(*block, *[F.col(c).alias(f"b_{c}") for c in (source, "low", "high")])
    p = a.join(b, block).filter(F.col(f"a_{source}") < F.col(f"b_{source}"))
    gap = F.greatest(F.abs(F.col("a_high") - F.col("b_low")), F.abs(F.col("b_high") - F.col("a_low")))
    size = F.greatest(F.abs("a_high"), F.abs("b_high"), F.abs("a_low"), F.abs("b_low"))
    return p.withColumn("gap", gap).withColumn("relative", gap / size).filter(F.col("gap") > tolerance * size).withColumn("severity", F.lit(severity))


def validity_overlaps(spans: DataFrame, key: list[str], ident: str, start: str, end: str) -> DataFrame:
    """Pairs a < b of one key whose closed periods overlap; null bounds are open."""
    a, b = spans.select(*key, F.col(ident).alias("a"), F.col(start).alias("a_from"), F.col(end).alias("a_to")), spans.select(*key, F.col(ident).alias("b"), F.col(start).alias("b_from"), F.col(end).alias("b_to"))
    meet = (F.col("a_from").isNull() | F.col("b_to").isNull() | (F.col("a_from") <= F.col("b_to"))) & (F.col("b_from").isNull() | F.col("a_to").isNull() | (F.col("b_from") <= F.col("a_to")))
    return a.join(b, key).filter((F.col("a") < F.col("b")) & meet)


def typed_conflicts(claims: DataFrame) -> DataFrame:
    """(a, b, kind, severity) over claims (id, subject, predicate, object, value, valid_from, valid_to): the typed checks.

    Pairs share a subject and predicate. object: different objects while valid together (0.8); value: values apart by more
    than one percent (0.9); temporal: the same object in periods that do not meet (0.5).
    """
    c = claims.select("id", "subject", "predicate", "object", "value", "valid_from", "valid_to")
    a, b = c.toDF(*[f"a_{x}" if x not in ("subject", "predicate") else x for x in c.columns]), c.toDF(*[f"b_{x}" if x not in ("subject", "predicate") else x for x in c.columns])
    p = a.join(b, ["subject", "predicate"]).filter("a_id < b_id")
    meet = F.expr("(a_valid_from is null or b_valid_to is null or a_valid_from <= b_valid_to) and (b_valid_from is null or a_valid_to is null or b_valid_from <= a_valid_to)")
    checks = [
        ("object", 0.8, (F.lower("a_object") != F.lower("b_object")) & meet), ("value", 0.9, (F.abs(F.col("a_value") - F.col("b_value")) > 0.01 * F.greatest(F.abs("a_value"), F.abs("b_value"))) & meet),
        ("temporal", 0.5, (F.lower("a_object") == F.lower("b_object")) & ~meet),
    ]
    found = F.filter(F.array(*[F.when(x, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for k, s, x in checks]), lambda x: x.isNotNull())
    return p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.inline(found))
