"""Names that mean one entity: aliases closed transitively, across batches, with ids that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlight.sources.places import shared_folder


def _kept(df: DataFrame, what: str) -> DataFrame:
    place = shared_folder(df.sparkSession, what)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def groups(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that it is linked to, itself included.

    Every round hangs each node's larger neighbours on its smallest one, and then each node and its smaller neighbours on the
    smallest of those, until nothing changes; links of a group come down to a star in logarithmically many rounds. Each round
    is a table in the shared folder. Nulls link nothing; a link to itself names a node.
    """
    own = edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = _kept(own, "links")
    while True:
        before = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        met = large.join(low, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).distinct()
        now = _kept(small, "links")
        if now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == before:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def folded(name: Column) -> Column:
    """A name as it is compared: lower case, white space single and trimmed; null if nothing is left."""
    out = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    return F.when(out != "", out)


def resolve(index: DataFrame | None, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index with a batch of entities in it, and where ids moved: (name, id) and (was, id).

    batch: rows (id long, name string, aliases array<string>) of entities as they were extracted, each with an id of its own.
    index: (name, id) as an earlier call gave it, or None. Names and aliases are compared folded. All names that a chain of
    aliases connects, in whatever batch its links came, are one entity, cycles included. It keeps the smallest id that the
    index had for any of its names, else gets the smallest of its rows. An id of the index that another took over is in the
    second table, so that stored references can follow; ids of the index never change otherwise. An entity whose name and
    aliases are all empty is not in the index.
    """
    said = batch.select("id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.expr("array()").cast("array<string>")))).alias("alias"), folded(F.col("name")).alias("name"))
    said = said.select("id", F.coalesce("name", folded(F.col("alias"))).alias("a"), folded(F.col("alias")).alias("b")).filter("b is not null")
    # an entity without a name of its own hangs together by its id
    links = said.select(F.concat(F.lit("#"), F.col("id").cast("string")).alias("a"), F.concat(F.lit("="), "b").alias("b"))
    proposed = said.select(F.concat(F.lit("="), "b").alias("node"), F.col("id"), F.lit(1).alias("rank"))
    if index is not None:
        known = index.select(F.concat(F.lit("="), "name").alias("node"), "id", F.lit(0).alias("rank"))
        links = links.unionByName(known.select(F.concat(F.lit("@"), F.col("id").cast("string")).alias("a"), F.col("node").alias("b")))
        proposed = proposed.unionByName(known)
    root = groups(links)
    owner = root.join(proposed, "node").groupBy("root").agg(F.min(F.struct("rank", "id"))["id"].alias("id"))
    out = _kept(root.filter("node like '=%'").join(owner, "root").select(F.substring("node", 2, 1 << 30).alias("name"), "id"), "names")
    if index is None:
        return out, out.sparkSession.createDataFrame([], "was long, id long")
    moved = index.select("name", F.col("id").alias("was")).join(out, "name").filter("was <> id").select("was", "id").distinct()
    return out, moved


def looked_up(index: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """names with the id that the index has for them; null for unknown ones."""
    return names.withColumn("_n", folded(F.col(name))).join(index.toDF("_n", "id"), "_n", "left").drop("_n")
