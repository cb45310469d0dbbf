"""Names within texts by partial ratio: the best alignment of the shorter string with a stretch of the longer one."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Longest grams that seed a pair.
LONGEST_GRAM = 4
_EPS = 1e-9


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slid(s: str, t: str) -> float:
    """The best 2 LCS / (lengths) of s with a window of t: as long as s, or a shorter one at either end of t.

    All windows at once: a longest common subsequence is kept as bits of s, one addition a character of the window.
    """
    m, a, b = len(s), _codes(s), _codes(t)
    letters, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    edge = np.full(m - 1, len(letters))
    padded = np.concatenate((edge, place[m:], edge))
    n = len(b) + m - 1
    if m <= 62:
        match = np.zeros(len(letters) + 1, np.uint64)
        np.bitwise_or.at(match, place[:m], np.uint64(1) << np.arange(m, dtype=np.uint64))
        v = np.full(n, ~np.uint64(0))
        for j in range(m):
            u = v & match[padded[j : j + n]]
            v = (v + u) | (v - u)
        common = np.bitwise_count(~v & np.uint64((1 << m) - 1))
    else:
        bits = [0] * (len(letters) + 1)
        for i, c in enumerate(place[:m].tolist()):
            bits[c] |= 1 << i
        full, common, chars = (1 << m) - 1, np.zeros(n), padded.tolist()
        for i in range(n):
            v = full
            for c in chars[i : i + m]:
                u = v & bits[c]
                v = ((v + u) | (v - u)) & full
            common[i] = m - v.bit_count()
    start = np.arange(n) - (m - 1)
    width = np.minimum(start + m, len(b)) - np.maximum(start, 0)
    return float((2 * common / (m + width)).max())


def partial_ratio(a: str, b: str) -> float:
    """1 for equal strings or one within the other, down to 0; two empty strings are alike, an empty one is like no other."""
    if not a or not b:
        return float(a == b)
    if len(a) == len(b):
        return max(_slid(a, b), _slid(b, a))
    return _slid(a, b) if len(a) < len(b) else _slid(b, a)


def seeds(m: int, least: float) -> tuple[int, int]:
    """(q, c): a string of m characters with partial ratio `least` to another has c grams of q characters in common with it.

    Of m characters and v of the window, L are aligned, with 2 L >= least (m + v), so the window has at least
    least m / (2 - least). The (m - L) + (v - L) others cut the aligned ones into one run more than they are, so the longest
    run, and the number of grams inside runs, are at least what an even cut leaves. Both grow with m + v, so the shortest
    window decides.
    """
    total = 2 * m / (2 - least)
    whole, runs = least * total / 2, (1 - least) * total + 1
    q = max(1, min(LONGEST_GRAM, m, ceil(whole / runs - _EPS)))
    while q > 1 and whole - runs * (q - 1) < 0:
        q -= 1
    return q, max(1, ceil(whole - runs * (q - 1) - _EPS))


def names_in_texts(names: DataFrame, texts: DataFrame, least: float = 0.8) -> DataFrame:
    """(id, key, likeness): the names (id, name) that are in a text (key, text) with a partial ratio of `least` or more.

    Letters of either case are alike. A pair must share grams of the shorter string, as many as `seeds` proves; of a name's
    grams so many less one, the most frequent in the texts, are left out, so that the commonest ones meet nothing, and a pair
    that has met is counted before it is aligned. Texts shorter than a name are met as if they were the name. No pair is lost:
    without a gram in common the ratio is below `least`. Nulls are in no pair; an empty name is in empty texts only.
    """
    if not 0 < least <= 1:
        raise ValueError("least is above 0, up to 1")
    n = names.select("id", F.lower("name").alias("name")).filter("name is not null")
    t = texts.select("key", F.lower("text").alias("text")).filter("text is not null")
    known = n.select("name").distinct()
    long = t.select("text").distinct()
    met = _met(known.toDF("s"), long.toDF("t"), least, False).toDF("name", "text")
    most = known.agg(F.max(F.length("name"))).first()[0] or 0
    met = met.unionByName(_met(long.filter(F.length("text") < most).toDF("s"), known.toDF("t"), least, True).toDF("text", "name").select("name", "text")).distinct()

    def run(batches):
        for b in batches:
            r = [partial_ratio(x, y) for x, y in zip(b.column("name").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("text"), pa.array(r, pa.float64())], names=["name", "text", "likeness"])

    near = met.mapInArrow(run, "name string, text string, likeness double").filter(F.col("likeness") >= least - _EPS)
    return n.join(near, "name").join(t, "text").select("id", "key", "likeness")


def _met(short: DataFrame, long: DataFrame, least: float, strict: bool) -> DataFrame:
    """(s, t) with s not longer (strict: shorter) than t that share as many grams as `seeds` asks for."""
    size = F.length("s")
    lengths = [r[0] for r in short.select(size).distinct().collect()]  # of distinct lengths only
    by = {m: seeds(m, least) for m in lengths if m}
    if not by:
        return short.join(long, F.col("s") == F.col("t")).select("s", "t")
    table = lambda i: F.create_map(*[F.lit(x) for m, v in by.items() for x in (m, v[i])])[size]
    cut = lambda c, q: F.transform(F.sequence(F.lit(1), F.length(c) - q + 1), lambda i: F.substring(F.col(c), i, q))
    qs = sorted({q for q, _ in by.values()})
    mine = short.filter(size > 0).withColumns({"q": table(0), "c": table(1)})
    mine = mine.select("s", "q", "c", F.posexplode(cut("s", F.col("q"))).alias("i", "g"))
    theirs = long.select("t", F.explode(F.array(*[F.lit(q) for q in qs])).alias("q")).filter(F.length("t") >= F.col("q")).select("t", "q", F.explode(F.array_distinct(cut("t", F.col("q")))).alias("g"))
    often = theirs.groupBy("q", "g").agg(F.count(F.lit(1)).alias("n"))
    ranked = mine.join(often, ["q", "g"]).withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("n", "g", "i")))
    # grams that no text has count as the rarest
    there = ranked.withColumn("have", F.count(F.lit(1)).over(Window.partitionBy("s")))
    rare = there.filter(F.col("r") <= F.col("have") - F.col("c") + 1)
    pairs = rare.select("s", "c", "q", "g").distinct().join(theirs, ["q", "g"]).select("s", "t", "c", "q").distinct()
    pairs = pairs.filter(F.length("s") < F.length("t") if strict else F.length("s") <= F.length("t"))
    grams = F.filter(cut("s", F.col("q")), lambda g: F.contains(F.col("t"), g))
    return pairs.filter(F.size(grams) >= F.col("c")).select("s", "t").unionByName(short.join(long, F.col("s") == F.col("t")).filter("s = ''").select("s", "t"))
