"""Phrase collocation mining by hierarchical pair naming: a frequent k-gram is a named pair of (k-1)-gram names.

Texts become blocks of word numbers, cut between texts. At each level a block's distinct adjacent pairs are counted in its
task; the counts of a pair meet by its two names, frequent pairs get a name (a number that is theirs alone), and sequences
are replaced by names of the next level: the most frequent pairs, a bounded number, are looked up in a broadcast table, and
the others are joined. A name's two parents are its first and last k-1 words, so counts of prefixes, suffixes and contained
phrases are found by following them. What meets by key is at most one row a block for a word or pair, however often it occurs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlight.llm.common import discard, give_back, written

#: Bytes of text in a block, about: a longer text makes a longer block.
BLOCK_BYTES = 8 << 20
#: Pairs that are broadcast at most (24 bytes each); the names of others reach their blocks by a join.
HOT_PAIRS = 1 << 20
#: Salts of the first of two rankings within a language.
RANK_SALTS = 64
BREAK = re.compile(rb"[.,;:!?\x0a-\x0d]")


def packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers, np.uint32).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint32)


def _single_breaks(seq: np.ndarray) -> np.ndarray:
    """seq with runs of zeros (breaks) cut to one."""
    return seq[(seq != 0) | (np.concatenate(([1], seq[:-1])) != 0)] if len(seq) else seq


class _Words(dict):
    """Numbers of words as they are met; 0 is the end of a piece."""

    def __init__(self):
        self[b"\n"] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_blocks(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(block long, lang, seq binary, words array<string>, counts array<long>): texts as word numbers, 0 between pieces.

    A-Z are lower-cased; pieces end at [.,;:!?] and line ends, words are runs of other than blank and tab. A null text is
    empty and a null language `und`. A block holds texts of one language and one task.
    """
    rows = docs.select(docs[text_col].cast("string").cast("binary").alias("text"), F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang")).filter("length(text) > 0")

    def run(batches):
        open_: dict[str, tuple[_Words, list]] = {}
        held, made = 0, TaskContext.get().partitionId() << 32

        def closed():
            nonlocal held, made
            for lang, (vocabulary, parts) in open_.items():
                seq = np.concatenate(parts)
                words = pa.array(list(vocabulary)[1:], pa.binary()).cast(pa.string())
                lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(np.bincount(seq, minlength=len(vocabulary))[1:], pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([lang], pa.string()), pa.array([packed(seq)], pa.binary()), *lists], names=["block", "lang", "seq", "words", "counts"])
                made += 1
            open_.clear()
            held = 0

        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                data = text.as_py().lower()
                words = [w for w in BREAK.sub(b" \n ", data.replace(b"\t", b" ")).split(b" ") if w]
                vocabulary, parts = open_.setdefault(lang, (_Words(), []))
                parts += [_single_breaks(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words))), np.zeros(1, np.uint32)]
                held += len(data)
                if held >= BLOCK_BYTES:
                    yield from closed()
        yield from closed()
        give_back()

    return rows.mapInArrow(run, "block long, lang string, seq binary, words array<string>, counts array<long>")


def _pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right numbers of the distinct adjacent pairs of seq, and per place the pair's number from 1, or 0."""
    if len(seq) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    wide = int(seq.max()) + 1
    whole = (seq[:-1] != 0) & (seq[1:] != 0)
    keys, place = np.unique(seq[:-1][whole].astype(np.int64) * wide + seq[1:][whole], return_inverse=True)
    at = np.zeros(len(whole), np.int64)
    at[whole] = place + 1
    return keys // wide, keys % wide, at


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(left long, right long, n long) per distinct adjacent pair of names of a block (block, seq, names)."""

    def run(batches):
        for b in batches:
            for seq, names in zip(b.column("seq"), b.column("names"), strict=True):
                left, right, at = _pairs(unpacked(seq.as_py()))
                if len(left):
                    own = names.values.to_numpy()
                    n = np.bincount(at, minlength=len(left) + 1)[1:]
                    yield pa.RecordBatch.from_arrays([pa.array(own[left - 1]), pa.array(own[right - 1]), pa.array(n, pa.int64())], names=["left", "right", "n"])
        give_back()

    return blocks.mapInArrow(run, "left long, right long, n long")


def word_names(blocks: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Where the frequent words are: (block, at, lang, word, f, id), and their names (id, lang, word, f).

    Both sides of the join read one exchange, as a word has one row a block. A word's rows are all made by one task, which
    gives it its name; names hold from when they are written.
    """
    rows = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("block", (F.col("at") + 1).alias("at"), "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    dealt = rows.repartition("lang", "word")
    counts = dealt.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id())
    kept = written(dealt.join(counts.hint("shuffle_hash"), ["lang", "word"]).select("block", "at", "lang", "word", "f", "id"), "kept")
    return kept, kept.groupBy("id").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.first("f").alias("f"))


class PairTable:
    """Names of pairs, looked up exactly: both sides by rank, then the pair of ranks."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ids: np.ndarray):
        self.left, self.right = np.unique(left), np.unique(right)
        keys = np.searchsorted(self.left, left) * max(1, len(self.right)) + np.searchsorted(self.right, right)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    @staticmethod
    def _rank(known: np.ndarray, names: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, names), max(0, len(known) - 1))
        return np.where(known[at] == names, at, -1) if len(known) else np.full(len(names), -1)

    def find(self, names: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of pairs of places (from 1) in names; -1 for others."""
        a, z = self._rank(self.left, names)[left - 1], self._rank(self.right, names)[right - 1]
        out = np.full(len(left), -1, np.int64)
        both = np.flatnonzero((a >= 0) & (z >= 0))
        at = self._rank(self.keys, a[both] * max(1, len(self.right)) + z[both])
        out[both[at >= 0]] = self.ids[at[at >= 0]]
        return out


def _renamed(block: int, at: np.ndarray, old: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A block whose numbers `old` become 1, 2, ... with the names ids; all others end a run."""
    new = np.zeros(int(at.max(initial=0)) + 1, np.uint32)
    new[old] = np.arange(1, len(old) + 1)
    names = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed(_single_breaks(new[at]))], pa.binary()), names], names=["block", "seq", "names"])


BLOCK = "block long, seq binary, names array<long>"


def in_words(blocks: DataFrame, kept: DataFrame) -> DataFrame:
    """(block, seq, names): the blocks' sequences of frequent words."""
    found = kept.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("found"))

    def run(batches):
        for b in batches:
            for block, seq, have in zip(b.column("block"), b.column("seq"), b.column("found"), strict=True):
                yield _renamed(block.as_py(), unpacked(seq.as_py()), *(have.values.field(i).to_numpy() for i in (0, 1)))
        give_back()

    return blocks.select("block", "seq").join(found, "block").mapInArrow(run, BLOCK)


def in_pairs(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(block, seq, names): the blocks' sequences of frequent pairs; names: (id, left, right, f) as a table."""
    spark = blocks.sparkSession
    per = {r["b"]: r["count"] for r in names.groupBy(F.floor(F.log2("f")).cast("int").alias("b")).count().collect()}
    cut = next((b + 1 for b in range(63, -1, -1) if sum(n for k, n in per.items() if k >= b) > HOT_PAIRS), 0)
    hot = names.filter(F.col("f") >= 1 << cut).select("left", "right", "id").toArrow()
    shared = spark.sparkContext.broadcast(PairTable(*(hot.column(c).to_numpy() for c in ("left", "right", "id"))))

    def hot_and_rest(seq, own):
        left, right, at = _pairs(unpacked(seq))
        own = own.values.to_numpy() if len(own) else np.empty(0, np.int64)
        return left, right, at, own, shared.value.find(own, left, right)

    def run(batches):
        for b in batches:
            rest = b.column("found") if "found" in b.schema.names else [None] * b.num_rows
            for block, seq, own, have in zip(b.column("block"), b.column("seq"), b.column("names"), rest, strict=True):
                _, _, at, _, ids = hot_and_rest(seq.as_py(), own)
                old = np.flatnonzero(ids >= 0) + 1
                ids = ids[old - 1]
                if have is not None and have.is_valid:
                    old, ids = np.concatenate((old, have.values.field(0).to_numpy())), np.concatenate((ids, have.values.field(1).to_numpy()))
                if len(old):
                    yield _renamed(block.as_py(), at, old, ids)
        give_back()

    def others(batches):
        for b in batches:
            for block, seq, own in zip(b.column("block"), b.column("seq"), b.column("names"), strict=True):
                left, right, _, own, ids = hot_and_rest(seq.as_py(), own)
                at = np.flatnonzero(ids < 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block.as_py(), np.int64)), pa.array((at + 1).astype(np.int32)), pa.array(own[left[at] - 1]), pa.array(own[right[at] - 1])], names=["block", "at", "left", "right"])
        give_back()

    if any(b < cut for b in per):
        rest = blocks.mapInArrow(others, "block long, at int, left long, right long").join(names.filter(F.col("f") < 1 << cut), ["left", "right"])
        blocks = blocks.join(rest.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("found")), "block", "left")
    return blocks.mapInArrow(run, BLOCK)


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, inside: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of 2 to `longest` words of each language.

    n counts all words of the language, a the phrase, l and r the two sides of its weakest cut (lowest
    floor(2000000 a / (l + r)), the first of equal ones). A phrase within a longer one of which `inside` per cent of its
    occurrences are goes; a longer phrase of more words holds it inside one of one word more, so only those are asked.
    Phrases occur `least` times or more. Scores and shares are computed in decimals. Ties go to the larger a, then to the
    phrase in byte order. Null texts are empty, a null language is `und`; repeated rows count each; further columns are
    dropped; a table without words gives no row. The result is computed when this is called.
    """
    blocks = written(word_blocks(docs, text_col, lang_col), "blocks")
    totals = written(blocks.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (s, x) -> s + x)")).alias("n")), "totals")
    kept, names = word_names(blocks, least)
    known = written(names.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("pre"), F.array("f").alias("suf")), "level")
    levels = [known]
    new = written(in_words(blocks, kept), "blocks")
    discard(blocks, kept)
    blocks = new
    for k in range(2, longest + 1):
        counts = pair_counts(blocks).groupBy("left", "right").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        names = written(counts.withColumn("id", F.monotonically_increasing_id()), "names")
        first = known.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.col("pre").alias("heads"))
        rest = known.select(F.col("id").alias("right"), "last", F.col("suf").alias("tails"))
        known = written(names.join(first, "left").join(rest, "right").select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", F.concat("heads", F.array("f")).alias("pre"), F.concat("tails", F.array("f")).alias("suf"), "left", "right"), "level")
        levels.append(known)
        if k < longest:
            new = written(in_pairs(blocks, names), "blocks")
            discard(blocks)
            blocks = new
        discard(names)
    discard(blocks)
    spent = [totals, *levels]
    scored = []
    for k in range(2, longest + 1):
        cuts = [F.expr(f"struct(cast(cast(2000000 as decimal(7,0)) * cast(f as decimal(19,0)) div (cast(pre[{j - 1}] as decimal(19,0)) + cast(suf[{k - j - 1}] as decimal(19,0))) as long) as score, {j} as cut, pre[{j - 1}] as l, suf[{k - j - 1}] as r)") for j in range(1, k)]
        own = levels[k - 1].select("id", "lang", "phrase", F.col("f").alias("a"), F.array_min(F.array(*cuts)).alias("c"))
        if k < longest:
            longer = levels[k].select("f", F.explode(F.array("left", "right")).alias("id")).groupBy("id").agg(F.max("f").alias("longer"))
            own = own.join(longer, "id", "left").filter(f"longer is null or 100 * cast(longer as decimal(19,0)) < {inside} * cast(a as decimal(19,0))")
        scored.append(own.select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    every = scored[0]
    for s in scored[1:]:
        every = every.unionByName(s)
    salted = every.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(RANK_SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    out = written(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    discard(*spent)
    return out
