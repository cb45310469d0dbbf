"""Chunking: character windows, sections, provenance of windows, paragraph packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlight.functions import text as X


def windows(docs: DataFrame, size: int = 512, overlap: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, char_start, char_end, text): windows of `size` characters, each `size - overlap` after the last.

    Blank windows are dropped but keep their ordinal; the last windows may lie wholly in an overlap. Generated by a
    sequence and an explode inside the scan's stage: no shuffle. ValueError if the overlap is not smaller than the size.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    d = docs.select(F.col(id_col), F.col(text_col).alias("_t")).filter(F.length("_t") > 0)
    w = d.select(id_col, "_t", F.posexplode(F.sequence(F.lit(0), F.length("_t") - 1, F.lit(step))).alias("ordinal", "char_start"))
    return w.select(id_col, "ordinal", "char_start", F.least(F.col("char_start") + size, F.length("_t")).alias("char_end"), F.substring("_t", F.col("char_start") + 1, F.lit(size)).alias("text")).filter(F.col("text").rlike(r"\S"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segment, seg_start, seg_end, text): the lines of each text as segments with their places."""
    from pyspark.sql import Window

    e = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("segment", "text"))
    w = Window.partitionBy(id_col).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int")
    return e.withColumn("seg_start", start).withColumn("seg_end", F.col("seg_start") + F.length("text")).select(id_col, "segment", "seg_start", "seg_end", "text")


def provenance(chunks: DataFrame, segments: DataFrame, id_col: str = "doc_id", page: str = "segment", section: str = "text") -> DataFrame:
    """(id, ordinal, page_start, page_end, section): which segments a window overlaps; its section is the first of them.

    An interval-overlap join inside a document: equi-join on the document, then the range predicate.
    """
    s = segments.select(F.col(id_col), F.col(page).alias("_p"), F.col(section).alias("_s"), "seg_start", "seg_end")
    j = chunks.join(s, id_col).filter((F.col("seg_end") > F.col("char_start")) & (F.col("seg_start") < F.col("char_end")))
    return j.groupBy(id_col, "ordinal").agg(F.min("_p").alias("page_start"), F.max("_p").alias("page_end"), F.min_by("_s", "_p").alias("section"))


def sections(segments: DataFrame, limit: int = 512, id_col: str = "doc_id") -> DataFrame:
    """(id, ordinal, text): one chunk per segment, stripped; segments of more than `limit` estimated tokens in windows.

    A segment is compared in estimated tokens (characters / 4) and cut in characters, as the rule has it.
    """
    from pyspark.sql import Window

    s = segments.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text <> ''")
    long = X.token_estimate(F.col("text")) > limit
    cuts = F.when(long, F.sequence(F.lit(0), F.length("text") - 1, F.lit(limit))).otherwise(F.array(F.lit(0)))
    e = s.select(id_col, "segment", F.col("text").alias("_t"), long.alias("_long"), F.explode(cuts).alias("at"))
    e = e.select(id_col, "segment", "at", F.when(F.col("_long"), F.substring("_t", F.col("at") + 1, F.lit(limit))).otherwise(F.col("_t")).alias("text")).filter(F.col("text").rlike(r"\S"))
    return e.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("segment", "at")) - 1).alias("ordinal"), "text")


def packed_paragraphs(docs: DataFrame, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """(id, ordinal, text): paragraphs joined greedily while the joined text has at most `limit` characters."""
    step = F.expr(
        f"aggregate(filter(split({text_col}, '{separator}'), x -> trim(x) <> ''), named_struct('done', cast(array() as array<string>), 'cur', ''), "
        f"(a, x) -> IF(a.cur = '', named_struct('done', a.done, 'cur', x), IF(length(a.cur) + 2 + length(x) <= {limit}, named_struct('done', a.done, 'cur', concat(a.cur, '\\n\\n', x)), named_struct('done', array_append(a.done, a.cur), 'cur', x))), "
        "a -> IF(a.cur = '', a.done, array_append(a.done, a.cur)))"
    )
    return docs.select(F.col(id_col), F.posexplode(step).alias("ordinal", "text"))
