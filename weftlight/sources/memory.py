"""Chunks with their documents, and memory with its archive and tags, in one commit each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlight.operators.selection import layer_cap, supersede
from weftlight.sources.places import shared_folder
from weftlight.sources.snapshots import Manifest, Store


def ingest(store: Store, docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id", checksum: str = "checksum", writer: tuple[str, int] | None = None) -> int:
    """Add documents whose checksum the store has not, and their chunks: readers see both or neither. The new version.

    Of new documents with one checksum the smallest id stays. What was known is taken from the version this began at; if
    another ingest commits documents meanwhile, this one is made anew from the version after it.
    """

    def make(at: Manifest) -> dict[str, DataFrame]:
        first = docs.withColumn("_r", F.row_number().over(Window.partitionBy(checksum).orderBy(id_col))).filter("_r = 1").drop("_r")
        new = first if "documents" not in at.tables else first.join(store.read("documents", of=at).select(checksum), checksum, "left_anti").select(*docs.columns)
        return {"documents": new, "chunks": chunks.join(new.select(id_col), id_col, "left_semi").select(*chunks.columns)}

    return store.update(("documents",), make, writer, whole=False)


KEY = ("layer", "subject", "predicate")


def remember(store: Store, new: DataFrame, cap: int, writer: tuple[str, int] | None = None) -> int:
    """Add records (id, layer, subject, predicate, value, confidence, created, tags array<string>) to memory. The new version.

    Fresh evidence archives the standing record of its (layer, subject, predicate) if it differs and is at least as
    confident; a weaker newcomer is archived itself. Then each layer keeps `cap` records, the most confident and of those the
    newest, and the others are archived as over the cap. Tables: memory (live records), archive (record and reason), tags
    (tag, id) of live records; all change in one commit or not at all. Records are to be newer than those of earlier calls.
    """

    def make(at: Manifest) -> dict[str, DataFrame]:
        known = "memory" in at.tables
        every = store.read("memory", of=at).unionByName(new) if known else new
        place = shared_folder(store.spark, "judged")  # what three tables are made of is computed once
        supersede(every, list(KEY), "created", "value", "confidence", "id").write.parquet(place)
        judged = store.spark.read.parquet(place)
        live = judged.filter("live").drop("live")
        kept = layer_cap(live, "layer", cap, [F.desc("confidence"), F.desc("created"), F.col("id")])
        gone = judged.filter("not live").drop("live").withColumn("reason", F.lit("superseded")).unionByName(live.join(kept.select("id"), "id", "left_anti").select(*live.columns).withColumn("reason", F.lit("over the cap")))
        archive = store.read("archive", of=at).unionByName(gone) if known else gone
        return {"memory": kept, "archive": archive, "tags": kept.select(F.explode(F.array_distinct("tags")).alias("tag"), "id")}

    return store.update(("memory", "archive", "tags"), make, writer)


def forget(store: Store, ids: DataFrame, writer: tuple[str, int] | None = None) -> int:
    """Delete live records by id, and their tags, in one commit."""

    def make(at: Manifest) -> dict[str, DataFrame]:
        return {t: store.read(t, of=at).join(ids.select("id"), "id", "left_anti").select(*store.read(t, of=at).columns) for t in ("memory", "tags")}

    return store.update(("memory", "tags"), make, writer)


def tagged(store: Store, tags: DataFrame, version: int | None = None) -> DataFrame:
    """Live records that have any of the tags (tag), by the tag table of the same version."""
    at = store.manifest(version)
    ids = store.read("tags", of=at).join(tags.select("tag").distinct(), "tag", "left_semi").select("id").distinct()
    return store.read("memory", of=at).join(ids, "id", "left_semi")
