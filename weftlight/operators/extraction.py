"""Extraction: entity names, relations, metric values, dates, headings, tables; linking by alias and by likeness."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlight.functions import text as X

# Endings that an entity name loses (the first that fits), phrases that relate two entities, synonyms of predicates.
NAME_ENDINGS = ["database", "db", "engine", "system", "platform", "line", "project", "feature", "tool", "api", "inc", "corp", "co", "ltd", "llc"]
RELATIONS = [
    (r"depends?\s+on", "depends_on"), (r"integrates?\s+with", "integrates_with"), (r"part\s+of", "part_of"), (r"uses?\b", "uses"), (r"supplied?\s+by", "supplied_by"), (r"located?\s+in", "located_in"),
    (r"replaces?\b", "replaces"), (r"supports?\b", "supports"), (r"contains?\b", "contains"), (r"downstream\s+of", "downstream_of"), (r"upstream\s+of", "upstream_of"),
]
PREDICATE_GROUPS = [
    ["is", "was", "equals", "="], ["works at", "employed by", "works for", "employee of"], ["located in", "based in", "headquartered in", "in"], ["occurred in", "happened in", "took place in"],
    ["said", "stated", "claimed", "reported"], ["increased", "rose", "went up", "grew"], ["decreased", "fell", "dropped", "declined"],
]
#: Date formats, most precise first, with the precision they carry.
DATE_FORMATS = [("yyyy-MM-dd'T'HH:mm:ss", "second"), ("yyyy-MM-dd HH:mm:ss", "second"), ("yyyy-MM-dd", "day"), ("dd MMM yyyy", "day"), ("MMM d, yyyy", "day"), ("yyyy-MM", "month"), ("yyyy", "year")]
#: Names that are broadcast at most (of 16 characters on average); beyond them names and words meet by a shuffle.
MOST_NAMES = 1 << 18


def entity_name(name: Column) -> Column:
    """A name without its article, company form and one generic ending; words in lower case get a capital."""
    n = F.trim(F.regexp_replace(F.trim(name), r"(?i)^(the|a|an)\s+|\s+(inc|corp|co|ltd|llc)\.?$", ""))
    cut = F.trim(F.regexp_replace(n, "(?i) (?:" + "|".join(NAME_ENDINGS) + ")$", ""))
    n = F.when(F.length(cut) >= 2, cut).otherwise(n)
    return F.array_join(F.transform(F.filter(F.split(n, r"\s+"), lambda w: w != ""), lambda w: F.when(F.lower(w) == w, F.initcap(w)).otherwise(w)), " ")


def predicate_group(predicate: Column) -> Column:
    """The first synonym of a predicate's group, or the predicate itself, trimmed and in lower case."""
    p = F.lower(F.trim(predicate))
    out = p
    for g in PREDICATE_GROUPS:
        out = F.when(p.isin(g), F.lit(g[0])).otherwise(out)
    return out


def relations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 100) -> DataFrame:
    """(id, src, kind, dst): proper nouns around relation phrases, the nearest before as source and the first after as target.

    Offsets of every match are needed, so texts go through a batch function.
    """
    noun, kinds = re.compile(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), [(re.compile(p, re.I), k) for p, k in RELATIONS]
    key = docs.schema[id_col].dataType.simpleString()

    def run(frames):
        for f in frames:
            out = []
            for d, text in zip(f["k"], f["t"], strict=True):
                for p, kind in kinds:
                    for m in p.finditer(text or ""):
                        before = noun.findall(text[max(0, m.start() - reach) : m.start()])
                        after = noun.search(text[m.end() : m.end() + reach])
                        if before and after and before[-1] != after[0]:
                            out.append((d, before[-1], kind, after[0]))
            yield pd.DataFrame(out, columns=[id_col, "src", "kind", "dst"])

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInPandas(run, f"`{id_col}` {key}, src string, kind string, dst string")


def _named(metric: str):
    return lambda x: F.struct(F.lit(metric).alias("metric"), x.alias("raw"))


def metric_values(chunks: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, metric, value, unit, billions): numbers that directly follow a metric name; zeros and bare years are skipped."""
    unit = r"(billion|million|thousand|%|percent)?"
    parts = [F.transform(F.regexp_extract_all(text_col, F.lit(rf"(?i)(\b{m}\b[\s:]*(?:of|was|is|are|reached|totaled)?[\s:=$-]{{0,15}}\$?[\d,]+\.?\d*\s*{unit})"), 1), _named(m)) for m in sorted(X.METRICS)]
    e = chunks.select(*keys, F.explode(F.concat(*parts)).alias("m")).select(*keys, "m.metric", "m.raw")
    e = e.withColumn("value", F.regexp_replace(F.regexp_extract("raw", r"(?i)\$?([\d,]*\d[\d,]*\.?\d*)\s*" + unit + "$", 1), ",", "").try_cast("double")).withColumn("unit", F.lower(F.regexp_extract("raw", "(?i)" + unit + "$", 1)))
    e = e.filter((F.col("value") != 0) & ~((F.col("unit") == "") & F.col("value").between(2000, 2099)))
    short = F.when(F.col("unit") == "billion", "B").when(F.col("unit") == "million", "M").when(F.col("unit") == "thousand", "K").when(F.col("unit").isin("percent", "%"), "%").otherwise("")
    return e.select(*keys, "metric", "value", short.alias("unit"), X.scaled(F.col("value"), F.col("unit")).alias("billions"))


def parsed_date(raw: Column) -> tuple[Column, Column]:
    """(timestamp, precision) of a date in one of the known forms; nulls for anything else."""
    stamps = [(F.try_to_timestamp(F.trim(raw), F.lit(f)), p) for f, p in DATE_FORMATS]
    precision = F.lit(None).cast("string")
    for t, p in reversed(stamps):
        precision = F.when(t.isNotNull(), F.lit(p)).otherwise(precision)
    return F.coalesce(*[t for t, _ in stamps]), precision


def headings(lines: DataFrame, doc: str, size: str, at: str) -> DataFrame:
    """Adds level: 1 from 1.8 times the document's upper median size, 2 from 1.4, 3 above 1.2, else null."""
    med = lines.groupBy(doc).agg(F.element_at(F.array_sort(F.collect_list(size)), F.floor(F.count(size) / 2).cast("int") + 1).alias("_m"))
    ratio = F.col(size) / F.col("_m")
    return lines.join(med, doc).withColumn("level", F.when(ratio >= 1.8, 1).when(ratio >= 1.4, 2).when(ratio > 1.2, 3)).drop("_m")


def plain_heading(line: Column) -> Column:
    """Whether a line of bare text looks like a heading: upper case, a colon at its end, or short and capitalised."""
    t = F.trim(line)
    short = F.length(t) < 60
    return (t != "") & short & ((F.upper(t) == t) & t.rlike("[A-Z]") | t.endswith(":") | (t.rlike(r"^[A-Z]") & ~t.rlike(r"[.!?,;]$") & (F.size(F.split(t, r"\s+")) <= 8)))


def heading_paths(lines: DataFrame, doc: str, at: str, text: str, level: str = "level") -> DataFrame:
    """Adds path: the headings above a line, outermost first, as `A > B`."""
    w = Window.partitionBy(doc).orderBy(at)
    out, marks = lines, []
    for k in (1, 2, 3):
        # a heading of level k holds until one of the same or a higher level
        since = F.sum(F.when(F.col(level) < k, 1).otherwise(0)).over(w)
        out = out.withColumn(f"_g{k}", since)
        marks.append(F.last(F.when(F.col(level) == k, F.col(text)), ignorenulls=True).over(Window.partitionBy(doc, f"_g{k}").orderBy(at)))
    return out.withColumn("path", F.concat_ws(" > ", *marks)).drop("_g1", "_g2", "_g3")


def table_text(rows: Column) -> Column:
    """Rows (array of arrays) as lines `a | b`, padded to the widest row, a rule after the first."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.array_join(F.concat(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), F.array_repeat(F.lit(""), width - F.size(r))), " | ")
    rule = F.array_join(F.array_repeat(F.lit("---"), width), " | ")
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def looks_like_header(row: Column) -> Column:
    """At least half of the cells filled, none longer than 50 characters."""
    filled = F.filter(row, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return (F.size(row) > 0) & (F.size(filled) * 2 >= F.size(row)) & F.forall(filled, lambda x: F.length(x) <= 50)


def linked_entities(texts: DataFrame, names: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, id): entities (id, name) whose name occurs in a text, in any case, between word boundaries.

    Texts and names meet on the name's first word, so no pair of a text and a name is looked at that shares none. Only keys
    and words go to that meeting: a name that is one word is found by it, and for the others the texts of the keys that
    have the first word are fetched afterwards. Names of at most MOST_NAMES rows and characters are broadcast.
    """
    word = r"([\p{L}\p{N}_]+)"
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    n = names.select("id", spaced(F.lower("name")).alias("name"), F.regexp_extract(F.lower("name"), word, 1).alias("w")).filter("w <> ''")
    n = n.withColumn("alone", F.trim("name") == F.col("w"))
    size = n.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("chars"), F.count_if(~F.col("alone")).alias("longer")).first()
    if max(size["n"], size["chars"] // 16) <= MOST_NAMES:
        n = F.broadcast(n)
    t = texts.select(key, F.lower(text_col).alias("t"))
    hit = t.select(key, F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(word), 1))).alias("w")).join(n, "w")
    out = hit.filter("alone").select(key, "id")
    if size["longer"]:
        maybe = hit.filter("not alone").select(key, "id", "name").distinct()
        out = out.unionByName(t.join(maybe, key).filter(F.contains(spaced(F.col("t")), F.col("name"))).select(key, "id"))
    return out.distinct()


def similar_names(a: DataFrame, b: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness): names (id, name) with an edit likeness of `least` (above zero) or more.

    Names meet on letter pairs (single letters if least is under 0.75). An edit touches two pairs and shifts the others
    by one at most, so names this alike have a pair in common within that many places; names under two letters are keys.
    """
    q = 2 if least >= 0.75 else 1
    most = (1 - least) + 1e-9

    def grams(df, name, at):
        n = df.select(F.lower("name").alias(name)).filter(F.col(name).isNotNull()).distinct()
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - (q - 1), F.lit(1))), lambda i: F.substring(F.col(name), i, F.lit(q)))
        return n.select(name, F.posexplode(cut).alias(at, "k"))

    longest = F.greatest(F.length("x"), F.length("y"))
    near = (F.abs(F.length("x") - F.length("y")) <= most * longest) & (F.abs(F.col("i") - F.col("j")) <= most * longest)
    p = grams(a, "x", "i").join(grams(b, "y", "j"), "k").filter(near).select("x", "y").distinct()
    p = p.withColumn("likeness", 1 - F.levenshtein("x", "y") / F.greatest(longest, F.lit(1))).filter(F.col("likeness") >= least)
    p = a.select(F.col("id").alias("a"), F.lower("name").alias("x")).join(p, "x").join(b.select(F.col("id").alias("b"), F.lower("name").alias("y")), "y")
    return p.select("a", "b", "likeness")
