"""A folder of files kept in step with a store: what is new, changed, gone or broken, file by file."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlight.sources.files import kind_of
from weftlight.sources.places import Folder, shared_folder
from weftlight.sources.snapshots import Manifest, Store

#: Folders that a scan leaves out unless told otherwise (fixed values).
EXCLUDED = (".obsidian/**", ".git/**", ".trash/**")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob on a relative path: ** is any depth, * and ? stay within a name."""
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, kind, content): files below root with a known extension, but those that a glob of `exclude` matches.

    path is relative to root. Spark lists and reads, so root may be on any file system that it knows.
    """
    base = Folder(spark, root)
    here = base.fs.makeQualified(base._at("")).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = files.select(F.regexp_replace(F.substring("path", len(here) + 1, 1 << 30), "^/+", "").alias("path"), "content").withColumn("kind", kind_of(F.col("path")))
    for glob in exclude:
        rel = rel.filter(~F.col("path").rlike(glob_pattern(glob)))
    return rel.filter("kind is not null").select("path", "kind", "content")


def decoded(content: bytes) -> str:
    """UTF-8 text; anything else, and a file without text, is an error."""
    text = content.decode("utf-8-sig")
    if not text.strip():
        raise ValueError("no text")
    return text


READERS: dict[str, Callable[[bytes], str]] = {"text": decoded, "web": decoded, "spreadsheet": decoded}


def read_files(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, kind, checksum, text, error): a row per file; what a reader raises is its file's error, and no other file's.

    readers: a callable of a file's bytes for each kind; a kind without one is an error of each of its files.
    """
    have = READERS if readers is None else readers

    def run(batches):
        for b in batches:
            texts, errors = [], []
            for kind, content in zip(b.column("kind").to_pylist(), b.column("content"), strict=True):
                try:
                    if kind not in have:
                        raise ValueError(f"no reader for {kind}")
                    texts.append(have[kind](content.as_py()))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a reader may raise anything; it becomes the file's row
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("kind"), b.column("checksum"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "kind", "checksum", "text", "error"])

    rows = files.select("path", "kind", F.sha2("content", 256).alias("checksum"), "content")
    return rows.mapInArrow(run, "path string, kind string, checksum string, text string, error string")


def sync(store: Store, root: str, exclude: tuple[str, ...] = EXCLUDED, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Bring a store in step with a folder; (path, outcome, error) per file of this run or before it.

    outcome is new, changed, unchanged, deleted or failed. Tables: documents (path, kind, checksum, version, text), the
    current text of every file, versions counted from 1, and outcomes, those of the last run; both change in one commit. A
    file that fails keeps the document it had and is tried again next time. Files are read once; only changed documents are
    written anew in content, the others are carried over.
    """
    place = shared_folder(store.spark, "scanned")
    read_files(scan(store.spark, root, exclude), readers).write.parquet(place)
    found = store.spark.read.parquet(place)

    def make(at: Manifest) -> dict[str, DataFrame]:
        if "documents" in at.tables:
            old = store.read("documents", of=at)
        else:
            old = store.spark.createDataFrame([], "path string, kind string, checksum string, version int, text string")
        o, n = old.alias("o"), found.alias("n")
        both = o.join(n, F.col("o.path") == F.col("n.path"), "full_outer")
        outcome = (
            F.when(F.col("n.path").isNull(), "deleted").when(F.col("n.error").isNotNull(), "failed").when(F.col("o.path").isNull(), "new").when(F.col("o.checksum") == F.col("n.checksum"), "unchanged").otherwise("changed")
        )
        state = both.withColumn("outcome", outcome)
        fresh = F.col("outcome").isin("new", "changed")
        pick = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        kept = state.filter((F.col("outcome") != "deleted") & (F.col("o.path").isNotNull() | fresh))
        documents = kept.select(pick("path"), pick("kind"), pick("checksum"), (F.coalesce("o.version", F.lit(0)) + F.when(fresh, 1).otherwise(0)).cast("int").alias("version"), pick("text"))
        return {"documents": documents, "outcomes": state.select(F.coalesce("n.path", "o.path").alias("path"), "outcome", F.col("n.error").alias("error"))}

    version = store.update(("documents", "outcomes"), make)
    return store.read("outcomes", version)
