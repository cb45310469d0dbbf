"""Evidence by way of a graph: edges from what was extracted, seeds from first results, a bounded walk, and one list of both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Edge kinds that a search follows, what a hop keeps of a score, and the score of evidence that no edge scores (fixed values).
KINDS = ("RELATES_TO", "MENTIONS", "SUPPORTS", "DERIVED_FROM", "CONTRADICTS")
DECAY, UNSCORED = 0.8, 0.5
#: Results that names are taken from, names taken from them, and names that a walk starts from (fixed values).
NAMED_RESULTS, NAMES, STARTS = 5, 10, 5
PHRASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"


def derived_edges(entities: DataFrame, claims: DataFrame, events: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(src, src_type, dst, dst_type, kind, confidence, chunk): a row per edge and chunk that supports it.

    entities (id, confidence, chunks), claims (id, confidence, chunks, against, subject, object), events (id, confidence,
    chunks, participants, location); chunks, against and participants are arrays. A chunk MENTIONS its entities; a claim and
    an event are DERIVED_FROM their chunks; a chunk SUPPORTS its claims and CONTRADICTS those it is against; claims RELATE_TO
    subject and object, participants and places to their events. explicit: further edges of the same columns. Null ends
    make no edge; an edge between nodes that no chunk supports has a null chunk.
    """

    def edges(rows, src, src_type, dst, dst_type, kind, chunk):
        return rows.select(F.col(src).cast("string").alias("src"), F.lit(src_type).alias("src_type"), F.col(dst).cast("string").alias("dst"), F.lit(dst_type).alias("dst_type"), F.lit(kind).alias("kind"), "confidence", F.col(chunk).cast("string").alias("chunk")).filter("src is not null and dst is not null")

    each = lambda df, column, name: df.withColumn(name, F.explode(column))
    backed = lambda df: df.withColumn("chunk", F.explode_outer("chunks"))
    parts = [
        edges(each(entities, "chunks", "chunk"), "chunk", "chunk", "id", "entity", "MENTIONS", "chunk"),
        edges(each(claims, "chunks", "chunk"), "chunk", "chunk", "id", "claim", "DERIVED_FROM", "chunk"),
        edges(each(claims, "chunks", "chunk"), "chunk", "chunk", "id", "claim", "SUPPORTS", "chunk"),
        edges(each(claims, "against", "chunk"), "chunk", "chunk", "id", "claim", "CONTRADICTS", "chunk"),
        edges(backed(claims), "id", "claim", "subject", "entity", "RELATES_TO", "chunk"),
        edges(backed(claims), "id", "claim", "object", "entity", "RELATES_TO", "chunk"),
        edges(each(events, "chunks", "chunk"), "chunk", "chunk", "id", "event", "DERIVED_FROM", "chunk"),
        edges(backed(each(events, "participants", "participant")), "participant", "entity", "id", "event", "RELATES_TO", "chunk"),
        edges(backed(events), "location", "entity", "id", "event", "RELATES_TO", "chunk"),
    ]
    every = reduce(lambda a, b: a.unionByName(b), parts if explicit is None else [*parts, explicit])
    key = ["src", "src_type", "dst", "dst_type", "kind", "chunk"]
    return every.groupBy(*key).agg(F.max("confidence").alias("confidence"))


def seed_names(hits: DataFrame, question: str, text: str, more: DataFrame | None = None) -> DataFrame:
    """(question, turn, name): up to STARTS names to start from, in order.

    hits (question, rank, text): capitalised phrases of over two letters in the first NAMED_RESULTS texts, first seen first,
    at most NAMES of them. more (question, turn, name), such as names near the question's vector, come after those. Names
    that differ in case only are one.
    """
    found = hits.filter(F.col("rank") <= NAMED_RESULTS).select(question, "rank", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(PHRASE), F.lit(0))).alias("at", "name")).filter("length(name) > 2")
    first = found.groupBy(question, "name").agg(F.min(F.struct("rank", "at")).alias("o"))
    ranked = first.withColumn("turn", F.row_number().over(Window.partitionBy(question).orderBy("o", "name"))).filter(F.col("turn") <= NAMES).select(question, F.lit(0).alias("from"), "turn", "name")
    if more is not None:
        ranked = ranked.unionByName(more.select(question, F.lit(1).alias("from"), F.col("turn").cast("int").alias("turn"), "name"))
    one = ranked.withColumn("_l", F.row_number().over(Window.partitionBy(question, F.lower("name")).orderBy("from", "turn"))).filter("_l = 1")
    turn = F.row_number().over(Window.partitionBy(question).orderBy("from", "turn"))
    return one.withColumn("turn", turn).filter(F.col("turn") <= STARTS).select(question, "turn", "name")


def evidence(edges: DataFrame, node_chunks: DataFrame, seeds: DataFrame, question: str, hops: int = 2, kinds: tuple[str, ...] = KINDS, start: str | None = None, end: str | None = None) -> DataFrame:
    """(question, chunk, score): what a walk of at most `hops` steps from each question's seeds (question, node) finds.

    edges (src, dst, kind, confidence, chunk, and with a window valid_from and valid_to), node_chunks (node, chunk). A node
    is visited once, at its first step; nodes reached by the last step are not visited. An edge out of a visited node gives
    its chunk confidence * DECAY^step, the best of all edges; chunks of visited nodes, and of edges that the window leaves out
    and the walk does not follow, have UNSCORED unless an edge scores them. All questions walk at once: a step is one join
    of their frontiers with the edges, and what was visited leaves by an anti-join.
    """
    e = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("valid_from").isNull() | (F.col("valid_from") >= F.lit(start).cast("timestamp")))
    if end is not None:
        inside = inside & (F.col("valid_to").isNull() | (F.col("valid_to") <= F.lit(end).cast("timestamp")))
    e = e.select(F.col("src").alias("node"), "dst", "confidence", "chunk", inside.alias("inside"))
    front = visited = seeds.select(question, "node").distinct()
    found = []
    for hop in range(hops):
        step = front.join(e, "node")
        found += [step.select(question, "chunk", F.when(F.col("inside"), F.col("confidence") * DECAY**hop).alias("score")), front.join(node_chunks, "node").select(question, "chunk", F.lit(None).cast("double").alias("score"))]
        if hop + 1 < hops:
            front = step.filter("inside").select(question, F.col("dst").alias("node")).distinct().join(visited, [question, "node"], "left_anti")
            visited = visited.unionByName(front)
    every = reduce(lambda a, b: a.unionByName(b), found).filter("chunk is not null")
    return every.groupBy(question, "chunk").agg(F.coalesce(F.max("score"), F.lit(UNSCORED)).alias("score"))


def search(hits: DataFrame, names: DataFrame, edges: DataFrame, node_chunks: DataFrame, question: str, k: int, hops: int = 2, more: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """(question, chunk, score, rank): the first results and after them, up to k, what the graph adds.

    hits (question, chunk, text, score, rank) are kept in their order; names (name, node) says which nodes names mean,
    compared in lower case. Chunks of the graph come by score, then chunk. Questions without results have none.
    """
    seeds = seed_names(hits, question, "text", more).select(question, F.lower("name").alias("name")).join(names.select(F.lower("name").alias("name"), "node").distinct(), "name")
    graph = evidence(edges, node_chunks, seeds, question, hops, start=start, end=end).join(hits.select(question, "chunk"), [question, "chunk"], "left_anti")
    both = hits.select(question, "chunk", F.col("score").cast("double").alias("score"), F.lit(0).alias("from"), "rank").unionByName(graph.select(question, "chunk", "score", F.lit(1).alias("from"), F.lit(0).alias("rank")))
    order = F.row_number().over(Window.partitionBy(question).orderBy("from", "rank", F.desc("score"), "chunk"))
    return both.withColumn("rank", order).filter(F.col("rank") <= k).select(question, "chunk", "score", "rank")
