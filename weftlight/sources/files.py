"""Sources: directories of files, text, delimited tables, JSON lines, web pages, notes with front matter."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions and what they are ingested as (fixed values).
KINDS = {"md": "text", "markdown": "text", "txt": "text", "pdf": "pdf", "csv": "spreadsheet", "tsv": "spreadsheet", "xlsx": "spreadsheet", "html": "web", "htm": "web", "png": "image", "jpg": "image", "jpeg": "image"}


def kind_of(path: Column) -> Column:
    """The source type by extension; null if the extension is not ingested."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[ext]


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, bytes) of all files below root with a known extension, ordered by lower-cased path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    return files.withColumn("kind", kind_of(F.col("path"))).filter("kind is not null").orderBy(F.lower("path")).select("path", "kind", "bytes")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, checksum): a row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")).withColumn("checksum", F.sha2("text", 256))


def delimiter(sample: str) -> str:
    """The delimiter that splits the most sample lines into the same number (over one) of fields."""
    lines = [x for x in sample.splitlines() if x.strip()]
    best = max(",;\t|", key=lambda d: sum(x.count(d) == lines[0].count(d) > 0 for x in lines)) if lines else ","
    return best


def delimited(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A CSV file or folder with its delimiter found from the first kilobytes; all columns are strings."""
    first = spark.read.text(path).limit(20).collect()
    return spark.read.option("header", header).option("sep", delimiter("\n".join(r[0] for r in first))).csv(path)


def cells(sheet: DataFrame, key: str) -> DataFrame:
    """(key, column, value): the non-blank cells of a sheet."""
    names = [c for c in sheet.columns if c != key]
    return sheet.select(key, *[F.col(c).cast("string") for c in names]).unpivot(key, names, "column", "value").filter(F.trim("value") != "")


def sheet_text(cell_rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, line): a sheet's rows as lines `a | b | c`; missing cells are empty."""
    m = cell_rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("m"))
    return m.select(key, F.array_join(F.array(*[F.coalesce(F.col("m")[c], F.lit("")) for c in columns]), " | ").alias("line"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType, ident: str, at: str) -> DataFrame:
    """JSON lines without malformed ones; of rows with one id the latest."""
    from pyspark.sql import Window

    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(ident).orderBy(F.col(at).desc()))).filter("_r = 1").drop("_r")


# ---- web pages -----------------------------------------------------------------------------------------------------------

_STRIPPED = "script|style|nav|header|footer|aside|noscript"


def canonical_url(url: Column) -> Column:
    """Without query and fragment, https, no slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "^http://", "https://"), "/+$", "")


def is_web_url(url: Column) -> Column:
    """http or https with a public-looking host; loopback and private literal hosts are refused."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))
    private = host.rlike(r"^(localhost$|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.|\[)")
    return url.rlike("^https?://") & (host != "") & ~private


def unescaped(text: Column) -> Column:
    """The five XML entities and the non-breaking space; & last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.regexp_replace(text, name, char)
    return text


def page_text(html: Column) -> Column:
    """Lines of a page without scripts, styles, menus, headers, footers and asides: tags become line ends, blank lines go."""
    body = html
    for tag in _STRIPPED.split("|"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}>", "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", "\n")
    parts = F.transform(F.split(unescaped(body), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def page_metadata(html: Column) -> list[Column]:
    """title, language and character set of a page; null where it has none."""
    found = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    return [unescaped(found(r"(?is)<title[^>]*>(.*?)</title>")).alias("title"), found(r"(?is)<html[^>]*\blang=[\"']([^\"']+)").alias("page_lang"), found(r"(?is)<meta[^>]*\bcharset=[\"']?([A-Za-z0-9_-]+)").alias("charset")]


# ---- notes ---------------------------------------------------------------------------------------------------------------

NOTE_SCHEMA = "path string, title string, fields map<string,string>, tags array<string>, links array<struct<target:string,alias:string>>, sections array<struct<level:int,heading:string,path:string,start:int,end:int>>, callouts array<string>, code_blocks int"
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.M)


def parse_note(path: str, content: str) -> dict:
    """Front matter, headings with their paths and offsets, [[links|alias]], #tags, callouts and fenced code of a note."""
    fields, body, shift = {}, content or "", 0
    m = re.match(r"---\n(.*?)\n---\n?", body, re.S)
    if m:
        shift, body = m.end(), body[m.end() :]
        for line in m[1].splitlines():
            k, sep, v = line.partition(":")
            if sep and not line.startswith((" ", "-")):
                fields[k.strip()] = v.strip().strip("'\"")
    plain = re.sub(r"```.*?(?:```|\Z)", lambda x: " " * len(x[0]), body, flags=re.S)
    heads = list(_HEADING.finditer(plain))
    stack, sections = [], []
    for i, h in enumerate(heads):
        level = len(h[1])
        stack = [s for s in stack if s[0] < level] + [(level, h[2])]
        end = next((x.start() for x in heads[i + 1 :] if len(x[1]) <= level), len(body))
        sections.append({"level": level, "heading": h[2], "path": " > ".join(s[1] for s in stack), "start": h.start() + shift, "end": end + shift})
    tags = re.findall(r"[\w/-]+", fields.get("tags", "")) + re.findall(r"(?:^|\s)#([A-Za-z][\w/-]*)", plain)
    links = [{"target": a.strip(), "alias": b.strip() or None} for a, b in re.findall(r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]", plain)]
    title = fields.get("title") or (heads[0][2] if heads else re.sub(r"\.md$", "", path.rsplit("/", 1)[-1]))
    return {"path": path, "title": title, "fields": fields, "tags": list(dict.fromkeys(tags)), "links": links, "sections": sections, "callouts": re.findall(r"^>\s*\[!(\w+)\]", plain, re.M), "code_blocks": len(re.findall(r"```.*?(?:```|\Z)", body, re.S))}


def parse_notes(notes: DataFrame) -> DataFrame:
    """parse_note() of (path, content) rows, a batch at a time."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([parse_note(p, c) for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=[x.split(" ")[0] for x in ("path", "title", "fields", "tags", "links", "sections", "callouts", "code_blocks")])

    return notes.select("path", "content").mapInPandas(run, NOTE_SCHEMA)


def link_leaf(target: Column) -> Column:
    """The last part of a link target, without anchor and .md."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(target, "#.*$", ""), r"\.md$", ""), "/"), -1)


def diff(old: DataFrame, new: DataFrame, key: str, checksum: str) -> DataFrame:
    """(key, change): new, changed, unchanged or deleted, by a full outer join of two snapshots."""
    o, n = old.select(F.col(key), F.col(checksum).alias("_o")), new.select(F.col(key), F.col(checksum).alias("_n"))
    change = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))
