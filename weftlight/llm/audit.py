"""Filter interaction audit: joint-failure counts of all filter intersections, inverted to what every filter order does."""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlight.llm.common import columns, discard, written

#: White space between words, as a pattern.
SPACE = r"[\x20\x09-\x0D]+"


def standard_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null; null-free booleans."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, filters: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", copies: str = "E") -> DataFrame:
    """(id, part, one 0/1 long per filter) per row of docs; filter `copies` fails rows whose text some smaller id has.

    Each text is read once: flags and a SHA-256 go to a table. A first copy is found by a join on digest and id, so that a
    large group of copies is dealt out by its ids. A null id is no smaller id and has none before it. The table can be
    deleted (`_shared_path` of the result) when nothing is read from it any more.
    """
    rows = columns(docs, id_col, text_col, part_col).toDF("id", "text", "part").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    flags = written(
        rows.select("id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2("text", 256)).alias("digest"), *[c.cast("long").alias(n) for n, c in filters.items()]),
        "flags",
    )
    first = flags.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(1))
    out = flags.join(first, ["digest", "id"], "left").select("id", "part", *filters, F.when(F.col("id").isNull() | F.col("first").isNotNull(), 0).otherwise(1).cast("long").alias(copies))
    out._shared_path = flags._shared_path
    return out


def joint_failures(rows: DataFrame, names: list[str], kinds: list[str]) -> DataFrame:
    """(part, joint, joint_<kind> array<long>): element s counts the rows that fail every filter of the set s.

    rows: part, a 0/1 long per filter and per kind of row. Bit i of s is filter i. A set's count is the sum of the product
    of its flags; each part meets as one row per task, as the sums are combined before they are exchanged.
    """
    sets = range(1 << len(names))
    inside = [[F.col(n) for i, n in enumerate(names) if s >> i & 1] for s in sets]

    def sums(weight: Column) -> list[Column]:
        return [F.coalesce(F.sum(reduce(mul, flags, weight)), F.lit(0)) for flags in inside]

    return rows.groupBy("part").agg(*[F.array(*sums(w)).alias(n) for n, w in [("joint", F.lit(1).cast("long")), *[(f"joint_{k}", F.col(k)) for k in kinds]]])


def survivors(joint: str, k: int) -> Column:
    """Möbius inversion of a joint-failure array: element s counts the rows that pass every filter of s."""
    return F.expr(f"transform(sequence(0, {(1 << k) - 1}), s -> aggregate(sequence(0, {(1 << k) - 1}), 0L, (n, q) -> n + if(q & s = q, if(bit_count(q) % 2 = 0, {joint}[q], -{joint}[q]), 0L)))")


def unfolded(per: DataFrame, names: list[str], kinds: list[str]) -> DataFrame:
    """A row per part, filter order and step, from the parts' joint-failure counts.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, <kind>_lost per kind, shapley. Survivors of a
    set of filters follow by inclusion and exclusion, and shapley from the Harsanyi dividends of the removal game (a set's
    dividend is its joint failures, negative for even sizes, shared out among its filters), times the number of orders.
    Names are single characters. No part gives no row.
    """
    k, orders = len(names), ["".join(p) for p in permutations(names)]
    letters = "".join(names)
    per = per.select("part", "joint", survivors("joint", k).alias("pass"), *[survivors(f"joint_{x}", k).alias(f"pass_{x}") for x in kinds])
    steps = per.select("*", F.explode(F.lit(orders)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = "shiftleft(1, cast(instr('{0}', {1}) as int) - 1)"
    at = steps.select(
        "*",
        F.expr(bit.format(letters, "substr(filter_order, step, 1)")).alias("own"),
        F.expr(f"aggregate(filter(split(substr(filter_order, 1, step - 1), ''), c -> c <> ''), 0, (s, c) -> s | {bit.format(letters, 'c')})").alias("before"),
    )
    every = (1 << k) - 1
    return at.select(
        "part",
        "filter_order",
        "step",
        F.expr("pass[before | own]").alias("kept"),
        F.expr("pass[before] - pass[before | own]").alias("removed"),
        F.expr("joint[own] - (pass[before] - pass[before | own])").alias("redundant"),
        F.expr(f"pass[{every} & ~own] - pass[{every}]").alias("unique_fails"),
        *[F.expr(f"pass_{x}[before] - pass_{x}[before | own]").alias(f"{x}_lost") for x in kinds],
        F.expr(f"aggregate(sequence(1, {every}), 0L, (n, s) -> n + if(s & own = own, joint[s] * if(bit_count(s) % 2 = 1, 1L, -1L) * ({len(orders)} div bit_count(s)), 0L))").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of filters A to E over docs, with good (quality 1) and toxic documents lost.

    Null texts are empty and a null part is the empty string. Every row counts, repeated rows too; a document's label holds
    if any row of labels with its id has it, and null ids have none. Further columns of either table are ignored. An empty
    table gives no row; without labels nothing good or toxic is lost. The counts of a part (three arrays of 32) are computed
    when this is called, and the rows are unfolded from them.
    """
    filters = standard_filters(F.col("text"))
    rows = failures(docs, filters, id_col, text_col, part_col)
    marks = columns(labels, id_col, "quality", "toxic").toDF("id", "quality", "toxic").filter("id is not null and (quality = 1 or toxic = 1)")
    marks = marks.groupBy("id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    kinds = ["good", "toxic"]
    marked = rows.join(marks, "id", "left").na.fill(0, kinds).select("part", *filters, "E", *kinds)
    names = [*filters, "E"]
    counted = written(joint_failures(marked, names, kinds), "joint")
    discard(rows)
    return unfolded(counted, names, kinds)
