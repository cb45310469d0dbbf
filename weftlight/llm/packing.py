"""Hierarchical best-fit packing: partitions pack locally, then a tree of tasks merges underfull bins as items."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlight.llm.common import blocks, columns, resident, texts_of, written
from weftlight.llm.pretokens import BytePretokens, Cache, byte_level, library, segments

#: Pieces that one local task packs at most, at about; up to SPREAD tasks have FEW_PIECES each, as few pieces pack worse the
#: more tasks they are dealt to; and how many nodes a node of the tree merges.
PIECES_PER_TASK, FEW_PIECES, SPREAD, FAN_IN = 200_000, 4_000, 16, 8


class ByteIds:
    """Whole texts to little-endian 32-bit ids: the library's model sees each pre-token once while it is in a cache."""

    def __init__(self, path: str):
        self.path, self.cut = path, BytePretokens(path)
        tokenize, pack = library(path).model.tokenize, struct.pack

        def word(w: str) -> bytes:
            ids = [t.id for t in tokenize(byte_level(w))]
            return pack(f"<{len(ids)}I", *ids)

        words, pretokens = Cache(word, 150_000), self.cut.pretokens

        def chunk(c: str) -> bytes:
            found = pretokens(c)
            return word(c) if len(found) == 1 else b"".join([words[w] for w in found])

        self.plain = Cache(chunk)
        self.spaced = Cache(lambda key: chunk(key if key[0] == "\n" else " " + key))

    def encode(self, text: str) -> bytes:
        out = []
        for part, special in segments(self.path, text):
            if special is not None:
                out.append(np.array([special], "<u4").tobytes())
            elif part:
                keys, bare = self.cut.keys(part)
                if bare:
                    out.append(self.plain[keys[0]])
                    out.extend(map(self.spaced.__getitem__, keys[1:]))
                else:
                    out.extend(map(self.plain.__getitem__, keys))
        return b"".join(out)


def byte_ids(path: str) -> ByteIds:
    return resident(("byte ids", path), lambda: ByteIds(path))


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_uid, id_col, piece, start, length, ids_crc32): documents of more than `capacity` ids are cut, the remainder first."""
    key = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        c = byte_ids(path)
        for b in blocks(batches, 8 << 20):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts_of(b, text_col)):
                ids = c.encode(text) + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("_uid").take(take), b.column(id_col).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["_uid", id_col, "piece", "start", "length", "ids_crc32"],
            )

    return columns(docs, id_col, text_col).withColumn("_uid", F.monotonically_increasing_id()).mapInArrow(run, f"_uid long, `{id_col}` {key}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit in the given order: the bin and the offset of each item, and the fill of each bin.

    An item goes to the bin with the least room that still takes it, found by the lowest set bit of a mask over rooms.
    """
    bins, offsets, fills = [], [], []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for size in sizes:
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bins, offsets, fills


def _pack_partition(capacity: int):
    """Best fit decreasing over one partition; adds bin (the task's number in its upper bits), bin_offset and fill."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        length = t.column("length").to_numpy()
        order = np.lexsort((t.column("_uid").to_numpy(), -length))
        bins, offsets, fills = best_fit(length[order].tolist(), capacity)
        t = t.take(pa.array(order))
        base = TaskContext.get().partitionId() << 40
        bins = np.asarray(bins, np.int64)
        for name, values in (("bin", bins + base), ("bin_offset", np.asarray(offsets, np.int64)), ("fill", np.asarray(fills, np.int64)[bins])):
            t = t.append_column(name, pa.array(values))
        yield from t.to_batches(max_chunksize=50_000)

    return run


def _merge_node(capacity: int, fan_in: int, level: int):
    """Best fit decreasing over the underfull bins of the nodes that one node of the tree merges: (child, bin, shift, fill)."""

    def run(batches):
        import pandas as pd

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).to_pandas()
        out = []
        for _, g in whole.groupby(whole["bin"] // (1 << 40) // fan_in**level, sort=True):
            g = g.sort_values(["fill", "bin"], ascending=[False, True])
            bins, offsets, fills = best_fit(g["fill"].tolist(), capacity)
            first = {}
            for b, child in zip(bins, g["bin"], strict=True):
                first.setdefault(b, child)
            out.append(pd.DataFrame({"child": g["bin"].to_numpy(), "bin": [first[b] for b in bins], "shift": offsets, "fill": [fills[b] for b in bins]}))
        yield from pa.Table.from_pandas(pd.concat(out), preserve_index=False).to_batches(max_chunksize=50_000)

    return run


def _useful(bins: DataFrame, capacity: int, fan_in: int, run) -> DataFrame:
    """The bins of each tree node (`run`) that a merge of fan_in nodes can need.

    Best fit leaves each node at most one bin that is at most half full, and two bins above half never fit together. So a
    merge places fan_in small bins at most, and of bins with equal fill no more than fan_in can receive one. What is
    passed up is thus bounded by fan_in * capacity rows a node, and nothing is lost by leaving the others as they are.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(run, "fill").orderBy("bin")
    return bins.filter(F.col("fill") < capacity).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= fan_in).drop("_r")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """Pack all documents (ids, then end_id) into sequences of at most `capacity` ids.

    Returns (id_col, piece, start, length, ids_crc32, sequence_id, offset), a row per piece. Null and empty texts are the
    one end id. Repeated rows and ids are packed like any others; further columns are dropped; an empty table gives none.

    Full pieces are sequences of their own. The others are dealt evenly over tasks that pack them best-fit decreasing,
    then a tree merges underfull bins, fan_in nodes at a time. Each level is a table in the shared folder.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    short = cut.filter(F.col("length") < capacity)
    n = short.count()
    tasks = max(1, min(SPREAD, -(-n // FEW_PIECES)), -(-n // PIECES_PER_TASK))
    local = short.repartition(tasks, F.xxhash64("_uid", "piece")).mapInArrow(_pack_partition(capacity), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", bin long, bin_offset long, fill long")
    local = written(local, "bins")
    top = local.agg(F.max(F.shiftright("bin", 40))).collect()[0][0] or 0
    live = local.filter("bin_offset = 0").select("bin", "fill")
    moves, level = None, 1
    while top // fan_in ** (level - 1) > 0:
        run = F.floor(F.shiftright("bin", 40) / F.lit(fan_in ** (level - 1)))
        up = _useful(live, capacity, fan_in, run)
        node = F.floor(F.shiftright("bin", 40) / F.lit(fan_in**level))
        merged = written(up.repartition(node).mapInArrow(_merge_node(capacity, fan_in, level), "child long, bin long, shift long, fill long"), "merged")
        step = merged.select("child", F.col("bin").alias("parent"), "shift")
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("child").alias("parent"), F.col("parent").alias("up"), F.col("shift").alias("more"))
            # every bin passed up was made, or kept, one level below, so it has a row in moves
            moves = moves.join(later, "parent", "left").select("child", F.coalesce("up", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        live = merged.filter("child = bin").select("bin", "fill")
        level += 1
    if moves is None:
        moves = spark.createDataFrame([], "child long, parent long, shift long")
    moves = moves.withColumnRenamed("child", "bin")
    packed = local.join(moves, "bin", "left").select(id_col, "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    full = cut.filter(F.col("length") == capacity).select(id_col, "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
