"""Headings by `#` marks: where each one's scope ends, sections with their paths, and insertion into a heading's scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlight.operators.extraction import heading_paths

#: Levels of headings in a note, and in text that carries marks from recognition.
NOTE_LEVELS, TEXT_LEVELS = 6, 3


def marked_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = TEXT_LEVELS) -> DataFrame:
    """(id_col, at, line, level, title): the trimmed lines that are not empty; level and title are null but for headings.

    A heading is one to `levels` marks, a blank and a title. at numbers the lines of the whole text from 0.
    """
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("at", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    mark = F.regexp_extract("line", rf"^(#{{1,{levels}}}) ", 1)
    level = F.when(mark != "", F.length(mark))
    return lines.select(id_col, "at", "line", level.alias("level"), F.when(level.isNotNull(), F.trim(F.expr("substr(line, length(regexp_extract(line, '^#+', 0)) + 1)"))).alias("title"))


def scopes(lines: DataFrame, id_col: str = "doc_id", levels: int = TEXT_LEVELS) -> DataFrame:
    """(id_col, at, level, title, ends): each heading, and the line of the next one of its level or a higher one (null: none).

    For every level the next heading is a running minimum from the end of the text; a heading ends at the least of those of
    its own level and the higher ones. One sort of a text's headings, no pairs of them.
    """
    heads = lines.filter("level is not null")
    after = Window.partitionBy(id_col).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    following = heads.withColumns({f"_n{k}": F.min(F.when(F.col("level") == k, F.col("at"))).over(after) for k in range(1, levels + 1)})
    ends = F.least(F.lit(None).cast("int"), *[F.when(F.col("level") >= k, F.col(f"_n{k}")) for k in range(1, levels + 1)])
    return following.select(id_col, "at", "level", "title", ends.alias("ends"))


def sections(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, section, path, text): runs of lines under one path, headings left out; path is `A > B`, null before any heading.

    section numbers the runs of a text from 1. Two headings in a row that give the same path make one run.
    """
    w = Window.partitionBy(id_col).orderBy("at")
    pathed = heading_paths(lines, id_col, "at", "title").withColumn("path", F.when(F.col("path") != "", F.col("path"))).filter("level is null")
    turn = F.when(F.lag("at").over(w).isNull() | ~F.lag("path").over(w).eqNullSafe(F.col("path")), 1).otherwise(0)
    runs = pathed.withColumn("_t", turn).withColumn("section", F.sum("_t").over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return runs.groupBy(id_col, "section").agg(F.first("path", ignorenulls=True).alias("path"), body.alias("text"))


def inserted(content: Column, block: Column, heading: Column) -> Column:
    """A note's content with a block put at the end of a heading's scope.

    The first heading of that title counts, whatever the case of its letters; its scope ends at the next heading of the same
    or a higher level. A title that is not there is added at the end as a level-two heading with the block. Without a title
    the block goes to the end of the note. Null contents and blocks are empty. A narrow expression over whole notes.
    """
    body, new = F.coalesce(content, F.lit("")), F.regexp_replace(F.coalesce(block, F.lit("")), r"^\s+|\s+$", "")
    trimmed = lambda c: F.regexp_replace(c, r"\s+$", "")
    parts = F.split(body, rf"(?md)(?=^#{{1,{NOTE_LEVELS}}}\s+\S)")
    wanted = F.lower(F.trim(heading))
    marks = F.transform(parts, lambda p: F.length(F.regexp_extract(p, rf"^(#{{1,{NOTE_LEVELS}}})\s+\S", 1)))
    titles = F.transform(parts, lambda p: F.when(p.rlike(rf"^#{{1,{NOTE_LEVELS}}}\s+\S"), F.lower(F.trim(F.regexp_extract(p, r"(?d)^#+\s+(.+)", 1)))).otherwise(F.lit("\n")))
    at = F.array_position(titles, wanted)  # from 1; 0: not there
    level = F.element_at(marks, at.cast("int"))
    later = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda j: (j > at) & (F.element_at(marks, j) > 0) & (F.element_at(marks, j) <= level))
    cut = F.coalesce(F.get(later, F.lit(0)), F.size(parts) + 1)
    before = F.array_join(F.slice(parts, 1, cut - 1), "")
    rest = F.array_join(F.slice(parts, cut, F.size(parts)), "")
    clean = F.trim(F.regexp_replace(F.trim(heading), "^#+", ""))
    return (
        F.when(F.coalesce(F.trim(heading), F.lit("")) == "", F.concat(trimmed(body), F.lit("\n\n"), new, F.lit("\n")))
        .when(at == 0, F.concat(trimmed(body), F.lit("\n\n## "), clean, F.lit("\n\n"), new, F.lit("\n")))
        .otherwise(F.concat(trimmed(before), F.lit("\n\n"), new, F.lit("\n\n"), F.regexp_replace(rest, "^\n+", "")))
    )
