"""Token counts: pieces are counted once per distinct pre-token, then joined to per-document pre-token frequencies and summed."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlight.llm.common import HOT_CHARS, HOT_ENTRIES, blocks, columns, frequent, resident, texts_of, written
from weftlight.llm.pretokens import BytePretokens, Cache, library, segments

#: Distinct chunks that a task gathers before it hands its counts on.
TASK_ENTRIES = 300_000


def cutter(path: str) -> BytePretokens:
    return resident(("pretokens", path), lambda: BytePretokens(path))


def pretoken_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(pretoken, n) over all texts. Tasks sum before the shuffle, so a hot pre-token arrives once per task and flush."""

    def run(batches):
        cut = cutter(path)
        chunks: Counter = Counter()
        whole: Counter = Counter()

        def flush():
            for key, n in chunks.items():
                for p in cut.pretokens(key if key[0] == "\n" else " " + key):
                    whole[p] += n
            chunks.clear()
            out = pa.RecordBatch.from_arrays([pa.array(list(whole), pa.string()), pa.array(list(whole.values()), pa.int64())], names=["pretoken", "n"])
            whole.clear()
            return out

        for b in blocks(batches, 8 << 20):
            for text in texts_of(b, text_col):
                for part, special in segments(path, text):
                    if special is not None or not part:
                        continue
                    keys, bare = cut.keys(part)
                    if bare:
                        whole.update(cut.pretokens(keys[0]))
                        chunks.update(keys[1:])
                    else:
                        whole.update(keys)
            if len(chunks) + len(whole) > TASK_ENTRIES:
                yield flush()
        if chunks or whole:
            yield flush()

    return columns(docs, text_col).mapInArrow(run, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def with_pieces(counts: DataFrame, path: str) -> DataFrame:
    """Adds pieces, the library's number of tokens, to each distinct pre-token."""

    def run(batches):
        lib = library(path)
        for b in batches:
            pieces = [len(lib.encode(p, add_special_tokens=False)) for p in b.column("pretoken").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("pretoken"), b.column("n"), pa.array(pieces, pa.int32())], names=["pretoken", "n", "pieces"])

    return counts.mapInArrow(run, "pretoken string, n long, pieces int")


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_ENTRIES) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) per row for the byte-level BPE file at `path`; no ids are made.

    The dictionary (distinct pre-token, pieces) is a table in the shared folder. At most `hot` of its most frequent short
    entries are broadcast (at most hot * HOT_CHARS * 4 bytes) and joined inside the pass over the texts; the frequencies of
    all other pre-tokens are shuffled to the dictionary. Special strings inside texts are one token each, as by the
    library's default. Null and empty texts count zero; repeated rows and null or repeated ids each keep their own row;
    further columns are dropped.
    """
    spark = docs.sparkSession
    key = docs.schema[id_col].dataType.simpleString()
    docs = columns(docs, id_col, text_col)
    dictionary = written(with_pieces(pretoken_counts(docs, path, text_col), path), "pretokens")
    least = frequent(dictionary, "pretoken", most=hot)
    top = dictionary.filter((F.col("n") >= least) & (F.length("pretoken") <= HOT_CHARS)).select("pretoken", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))

    def run(batches):
        cut, pieces = cutter(path), known.value.get

        def look(key: str):
            total, rest = 0, []
            for p in cut.pretokens(key):
                k = pieces(p)
                if k is None:
                    rest.append(p)
                else:
                    total += k
            return total, rest

        spaced = Cache(lambda key: look(key if key[0] == "\n" else " " + key))
        for b in blocks(batches, 8 << 20):
            uids = b.column("_uid").to_pylist()
            out_uid, out_token, out_n, n_bytes, n_tokens, rows = [], [], [], [], [], []
            for i, text in enumerate(texts_of(b, text_col)):
                total, rest = 0, Counter()
                for part, special in segments(path, text):
                    if special is not None:
                        total += 1
                        continue
                    if not part:
                        continue
                    keys, bare = cut.keys(part)
                    if bare:
                        t, unknown = look(keys[0])
                        total += t
                        rest.update(unknown)
                        for k, f in Counter(keys[1:]).items():
                            t, unknown = spaced[k]
                            total += t * f
                            for p in unknown:
                                rest[p] += f
                    else:
                        for k, f in Counter(keys).items():
                            t = pieces(k)
                            if t is None:
                                rest[k] += f
                            else:
                                total += t * f
                rows.append(i)
                out_uid.append(uids[i])
                out_token.append(None)
                out_n.append(0)
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(total)
                for p, f in rest.items():
                    rows.append(None)
                    out_uid.append(uids[i])
                    out_token.append(p)
                    out_n.append(f)
                    n_bytes.append(None)
                    n_tokens.append(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_uid, pa.int64()), b.column(id_col).take(pa.array(rows, pa.int32())), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(out_token, pa.string()), pa.array(out_n, pa.int64())],
                names=["_uid", id_col, "n_bytes", "n_tokens", "pretoken", "f"],
            )

    parts = docs.withColumn("_uid", F.monotonically_increasing_id()).mapInArrow(run, f"_uid long, `{id_col}` {key}, n_bytes long, n_tokens long, pretoken string, f long")
    # rows of documents have no pre-token; a key of their own deals them out evenly
    parts = parts.withColumn("k", F.when(F.col("pretoken").isNull(), F.xxhash64("_uid")).otherwise(F.xxhash64("pretoken")))
    entries = dictionary.select(F.xxhash64("pretoken").alias("k"), "pretoken", "pieces")
    joined = parts.join(entries, ["k", "pretoken"], "left")
    per = joined.groupBy("_uid").agg(F.max(id_col).alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n_tokens") + F.col("f") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
    return per.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
