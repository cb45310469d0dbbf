"""Token ids as length-delimited binary records with masked checksums, and a separate offset index for shuffled reads.

A record file is a row of frames: length (8 bytes), masked CRC-32 of those 8 bytes, payload, masked CRC-32 of the payload;
all little-endian. The payload is a document: its id (8 bytes), whether that is null (1 byte), the width of a token id
(1 byte), the token ids. An index file is the magic `WLIX1`, then (offset 8 bytes, payload length 8 bytes) for each
record, then the masked CRC-32 of those. The mask is the rotation and addition that TFRecord files use.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlight.llm.common import blocks, new_path, resident, texts_of, written
from weftlight.llm.pretokens import Cache, WordPretokens, library, segments

MAGIC = b"WLIX1"
#: Bytes of records after which a task begins another file.
FILE_BYTES = 64 << 20
#: Added to a rotated checksum (fixed value of the TFRecord format).
MASK_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def unframe(data, at: int) -> tuple[bytes, int]:
    """The payload that begins at `at`, and where the next frame begins; ValueError if a checksum is wrong."""
    head = bytes(data[at : at + 8])
    (n,) = struct.unpack("<Q", head)
    if struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"length checksum at {at}")
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) != n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"payload checksum at {at}")
    return payload, at + 16 + n


def serialize(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack_from("<qBB", payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class RecordWriter:
    """One record file and its index; readable once close() has returned."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.at, self.index = uri, 0, []
        self.out, self.idx = fs.open_output_stream(path), fs.open_output_stream(path + ".idx")

    def write(self, payload: bytes) -> None:
        data = frame(payload)
        self.index.append((self.at, len(payload)))
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        body = np.array(self.index, "<u8").tobytes()
        self.idx.write(MAGIC + body + struct.pack("<I", masked(body)))
        self.idx.close()
        self.out.close()


def read_index(uri: str) -> np.ndarray:
    """(offset, payload length) of every record of a file."""
    fs, path = _fs(uri)
    with fs.open_input_stream(path + ".idx") as f:
        data = f.read()
    body = data[len(MAGIC) : -4]
    if data[: len(MAGIC)] != MAGIC or struct.unpack("<I", data[-4:])[0] != masked(body):
        raise ValueError(f"index of {uri}")
    return np.frombuffer(body, "<u8").reshape(-1, 2)


def read_records(uri: str, order: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of a file: in file order by streaming, or those at the given places of the index by ranged reads."""
    fs, path = _fs(uri)
    if order is None:
        with fs.open_input_stream(path) as f:
            while head := f.read(12):
                (n,) = struct.unpack_from("<Q", head)
                yield deserialize(unframe(head + f.read(n + 4), 0)[0])
        return
    index = read_index(uri)
    with fs.open_input_file(path) as f:
        for k in order:
            at, n = (int(x) for x in index[k])
            yield deserialize(unframe(f.read_at(n + 16, at), 0)[0])


def shuffled_records(uris: list[str], seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Every record once, files and records within a file in an order drawn from the seed; memory is one index."""
    rng = np.random.default_rng(seed)
    for k in rng.permutation(len(uris)):
        yield from read_records(uris[k], rng.permutation(len(read_index(uris[k]))))


class WordIds:
    """Whole texts to the library's ids for word_bpe_49k.

    The library's model sees each pre-token once while it is in a cache; chunks that differ in case or punctuation share
    their pre-tokens.
    """

    def __init__(self, path: str):
        self.path, self.cut, lib = path, WordPretokens(path), library(path)
        self.width = 2 if lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        tokenize, pack, letter = lib.model.tokenize, struct.pack, "H" if self.width == 2 else "I"

        def word(w: str) -> bytes:
            ids = [t.id for t in tokenize(w)]
            return pack(f"<{len(ids)}{letter}", *ids)

        self.words = Cache(word, 150_000)
        self.chunks = Cache(lambda c: b"".join([self.words[w] for w in self.cut.pretokens(c)]))

    def encode(self, text: str) -> bytes:
        out = []
        for part, special in segments(self.path, text):
            if special is None:
                out.extend(map(self.chunks.__getitem__, self.cut.chunks(part)))
            else:
                out.append(np.array([special], self.kind).tobytes())
        return b"".join(out)


def word_ids(path: str) -> WordIds:
    return resident(("word ids", path), lambda: WordIds(path))


def write_token_records(docs: DataFrame, path: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every document's ids and end_id under `out` in ascending id order; returns the manifest, a row per file.

    (part, seq, uri, n_records, n_ids). Range partitioning by id orders the files; each task streams, so its memory is one
    block of texts. A file's name holds a fresh token and only files in the manifest count, so tasks that are run twice or
    lost leave at most files that nobody reads.
    """

    def run(batches):
        c, part, seq, w, n, records = word_ids(path), TaskContext.get().partitionId(), 0, None, 0, 0
        end, made = np.array([end_id], c.kind).tobytes(), []
        for b in blocks(batches, 8 << 20):
            for key, text in zip(b.column(id_col).to_pylist(), texts_of(b, text_col), strict=True):
                if w is None:
                    w = RecordWriter(f"{out}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.rec")
                ids = c.encode(text) + end
                w.write(struct.pack("<qBB", key or 0, key is None, c.width) + ids)
                n, records = n + len(ids) // c.width, records + 1
                if w.at >= FILE_BYTES:
                    w.close()
                    made.append((part, seq, w.uri, records, n))
                    w, n, records, seq = None, 0, 0, seq + 1
        if w is not None:
            w.close()
            made.append((part, seq, w.uri, records, n))
        if made:
            cols = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["part", "seq", "uri", "n_records", "n_ids"])

    spark = docs.sparkSession
    d = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].alias(text_col))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(docs.inputFiles()))
    ordered = d.repartitionByRange(n, F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.xxhash64(text_col))
    return written(ordered.mapInArrow(run, "part int, seq int, uri string, n_records long, n_ids long"), "manifest")


def read_token_records(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) per record of the manifest's files; start counts all ids before the document."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches):
        for b in batches:
            for uri, at in zip(b.column("uri").to_pylist(), b.column("start").to_pylist(), strict=True):
                keys, start, n, crc = [], [], [], []

                def out():
                    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

                for key, ids in read_records(uri):
                    keys.append(key)
                    start.append(at)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.tobytes()))
                    at += len(ids)
                    if len(keys) >= 20_000:
                        yield out()
                        keys, start, n, crc = [], [], [], []
                if keys:
                    yield out()

    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return starts.select("uri", "start").repartition(n, "uri").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", out: str | None = None) -> DataFrame:
    """Write all documents as records, read the files back and describe each document from what was read.

    Null and empty texts are one end id; rows with equal ids keep an order of their own; further columns are dropped; an
    empty table writes no file and gives no row.
    """
    spark: SparkSession = docs.sparkSession
    out = out or new_path(spark, "records")
    return read_token_records(write_token_records(docs, path, out, end_id, id_col, text_col), id_col)
