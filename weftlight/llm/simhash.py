"""SimHash near-duplicates by covering LSH, linked exactly within a Hamming radius; near duplicates by shingle similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlight.llm.common import blocks, columns, discard, resident, texts_of, written
from weftlight.llm.components import components
from weftlight.llm.pretokens import Cache

#: Members of a bucket that one task compares pair by pair at most; fuller buckets are linked through shared neighbours.
BUCKET = 8192
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str) -> list[bytes]:
    """Words between space, tab, line feed, vertical tab, form feed and carriage return, A-Z lower-cased."""
    return text.encode("utf-8").translate(_LOWER).split()


def shingle_hashes(tokens: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of `size` words, joined by spaces, repeats included; of the whole if it is shorter."""
    if not tokens:
        return np.empty(0, ">u8")
    whole, digest = b" ".join(tokens), xxhash.xxh64_digest
    if len(tokens) <= size:
        return np.frombuffer(digest(whole, seed), ">u8")
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1))
    return np.frombuffer(b"".join([digest(whole[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]), ">u8")


def simhash(tokens: list[bytes], size: int = 4, seed: int = 42) -> bytes:
    """The fingerprint of the shingles' hashes, repeats included; all zero without words."""
    return majority(shingle_hashes(tokens, size, seed))


def majority(h: np.ndarray) -> bytes:
    """Eight bytes: a bit is one if it is set in over half the 64-bit hashes; all zero without any."""
    n = len(h)
    if not n:
        return bytes(8)
    ones = np.zeros(64, np.int64)
    raw = h.view(np.uint8).reshape(n, 8)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(raw[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long) of every row; null and empty texts have fingerprint zero."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        resident("simhash")
        for b in blocks(batches, 8 << 20):
            fps = b"".join([simhash(words(t), size, seed) for t in texts_of(b, text_col)])
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], names=[id_col, "fp"])

    return columns(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks such that any two words within the radius agree on all bits of some mask.

    Bit i is given a non-zero vector of radius+1 bits; mask v holds the bits whose vector has an odd product with v. At
    most `radius` differing bits have vectors that leave some v orthogonal to all of them, and that mask has none of them.
    """
    size = 1 << (radius + 1)
    vector = [i % (size - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """For rows of equally many fingerprints: for each the place of the first fingerprint of its component in the row."""
    n, m = fps.shape
    link = np.bitwise_count(fps[:, :, None] ^ fps[:, None, :]) <= radius
    label = np.broadcast_to(np.arange(m, dtype=np.int32), (n, m)).copy()
    while True:
        new = np.where(link, label[:, None, :], m).min(axis=2)
        new = np.take_along_axis(new, new, axis=1)
        if np.array_equal(new, label):
            return label
        label = new


def _linked_large(fps: np.ndarray, radius: int) -> np.ndarray:
    """The same for one long row, in strips of bounded memory."""
    m = len(fps)
    label = np.arange(m)
    for a in range(0, m, 256):
        near = np.bitwise_count(fps[a : a + 256, None] ^ fps[None, a:]) <= radius
        for i, row in enumerate(near):
            own = label[a:][row]
            low = min(own.min(), label[a + i])
            if (own != low).any():
                label[np.isin(label, np.unique(own))] = low
    return label


def links(fps: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b) edges with the same components as all pairs of distinct fingerprints within `radius` bits.

    fps has a column fp of distinct values. A bucket (table, masked value) of two is checked where it is counted; one of
    up to `bucket` members is compared by one task that returns a spanning forest, never its pairs; the members of fuller
    buckets are linked exactly through the words within half the radius of them (see `neighbour_links`).
    """
    masks = covering_masks(radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "k"))
    counted = written(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "buckets")
    two = counted.filter((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    some = keyed.join(counted.filter((F.col("n") > 2) & (F.col("n") <= bucket)).select("t", "k"), ["t", "k"])
    lists = some.groupBy("t", "k").agg(F.collect_list("fp").alias("m")).select("m")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column("m")
            flat, ends = m.flatten().to_numpy(zero_copy_only=False).view(np.uint64), m.offsets.to_numpy() - m.offsets[0].as_py()
            sizes = np.diff(ends)
            out = []
            for n in np.unique(sizes).tolist():
                at = ends[:-1][sizes == n]
                step = max(1, (1 << 21) // (n * n))
                for i in range(0, len(at), step):
                    rows = np.sort(flat[at[i : i + step, None] + np.arange(n)], axis=1)
                    first = _linked(rows, radius) if n <= 1024 else np.stack([_linked_large(r, radius) for r in rows])
                    moved = first != np.arange(n)
                    out.append(np.stack([rows[moved], np.take_along_axis(rows, first, axis=1)[moved]]))
            e = np.unique(np.concatenate(out, axis=1), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e[1]), pa.array(e[0])], names=["a", "b"])

    out = two.unionByName(lists.mapInArrow(run, "a long, b long"))
    crowded = counted.filter(F.col("n") > bucket).select("t", "k")
    if not crowded.isEmpty():
        out = out.unionByName(neighbour_links(written(keyed.join(crowded, ["t", "k"]).select("fp").distinct(), "crowded"), radius))
    return out.distinct()


def neighbour_links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b) edges that connect exactly the fingerprints of fps within `radius`, in rows linear in their number.

    Two words lie within an even radius exactly if some word lies within half of it of both. So every fingerprint is put
    under all words within half the radius (2081 for radius 4), and those under one word are linked to its smallest: such
    edges are true links by the triangle inequality, and no link lacks one. Partial minima keep hot words small.
    """
    if radius % 2:
        raise ValueError("an even radius is needed")
    flips = {0}
    for _ in range(radius // 2):
        flips |= {f ^ 1 << i for f in flips for i in range(64)}
    flips = sorted(_signed(f) for f in flips)
    spark = fps.sparkSession
    table = spark.createDataFrame([(f,) for f in flips], "f long").agg(F.collect_list("f").alias("fs"))
    under = fps.join(F.broadcast(table)).select("fp", F.explode("fs").alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("z"))
    least = under.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("z", "a")
    return under.join(least, "z").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def near_duplicate_components(docs: DataFrame, size: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id_col, fingerprint, component_id): the fingerprint in hex, and the smallest id reachable over links.

    Equal fingerprints are one node however many rows have it; texts without words all have fingerprint zero and link like
    any other. Null ids take part, but are a component's smallest id only if it has no other. Repeated rows each get a row;
    further columns are dropped; an empty table gives none.
    """
    rows = written(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius, bucket))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near duplicates by shingle similarity: fingerprints and bands only propose, whole texts decide --------------------

#: Minima of a text's shingle hashes under BANDS * ROWS orders; texts that agree on all ROWS of some band share a bucket.
BANDS, ROWS = 40, 5
_ORDERS = np.random.default_rng(42).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_FOLDS = np.random.default_rng(43).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64).reshape(BANDS, ROWS) | np.uint64(1)
#: Members of a bucket, and shingles of them, that meet in one task are those of two blocks of about so many.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20


def word_hashes() -> Cache:
    """XXH64 of words, kept by a worker between tasks."""
    return resident("word hashes", lambda: Cache(lambda w: xxhash.xxh64_intdigest(w, 42), 300_000))


def shingle_codes(text: str, size: int, codes: Cache) -> np.ndarray:
    """The set of a text's `size`-word shingles as sorted 64-bit hashes of their words' hashes; of the whole if it is shorter."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(w) - size + 1)
    h = w[:n].copy()
    for k in range(1, min(size, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ h >> np.uint64(32))


def shingle_set(text: str, size: int) -> set[bytes]:
    """The same set as strings (the plain form, for comparisons)."""
    w = words(text)
    return {b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} or ({b" ".join(w)} if w else set())


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key per band of the least shingle hashes: two texts of Jaccard similarity j agree on one with probability j^ROWS."""
    low = h.astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(least, (low[i : i + 512, None] * _ORDERS).min(axis=0), out=least)
    k = (least.reshape(BANDS, ROWS).astype(np.uint64) * _FOLDS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    k = (k ^ k >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (k ^ k >> np.uint64(29)).view(np.int64)


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """(uid, n, fp, keys) of every row (uid, text): number and SimHash of its different shingles, and its BANDS keys."""

    def run(batches):
        codes = word_hashes()
        for b in blocks(batches, 8 << 20):
            sets = [shingle_codes(t, size, codes) for t in texts_of(b)]
            fps = np.frombuffer(b"".join([majority(h) for h in sets]), np.int64)
            keys = pa.array(np.concatenate([band_keys(h) for h in sets]))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), keys)
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array([len(h) for h in sets], pa.int32()), pa.array(fps), keys], names=["uid", "n", "fp", "keys"])

    return docs.mapInArrow(run, "uid long, n int, fp long, keys array<long>")


def shingled(docs: DataFrame, size: int) -> DataFrame:
    """(uid, h, keys): the set of shingle hashes and the band keys of every row (uid, text), eight bytes each."""

    def run(batches):
        codes = word_hashes()
        for b in blocks(batches, 8 << 20):
            sets = [shingle_codes(t, size, codes) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array([band_keys(h).tobytes() for h in sets], pa.binary())], names=["uid", "h", "keys"])

    return docs.mapInArrow(run, "uid long, h binary, keys binary")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of uids whose sets of shingles (uid, h) have a Jaccard similarity of at least `least`."""

    def run(batches):
        for batch in batches:
            for b in blocks([batch], 4 << 20):
                keep = []
                for x, y in zip(b.column("ha"), b.column("hb"), strict=True):
                    s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    n = len(s) + len(t)
                    fits = min(len(s), len(t)) >= least * max(len(s), len(t))
                    both = n - len(np.unique(np.concatenate([s, t]))) if fits else 0
                    keep.append(fits and both >= least * (n - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    one = pairs.join(sets.select(F.col("uid").alias("a"), F.col("h").alias("ha")), "a")
    both = one.join(sets.select(F.col("uid").alias("b"), F.col("h").alias("hb")), "b")
    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _common(hashes: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets have in common; those of one set only are left out before."""
    m = len(hashes)
    own = np.repeat(np.arange(m), [len(h) for h in hashes])
    _, col, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    own, col = own[n[col] > 1], place[col[n[col] > 1]]
    order = np.argsort(col, kind="stable")
    own, col = own[order], col[order]
    out = np.zeros((m, m), np.int32)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        a, b = np.searchsorted(col, (lo, lo + 4096))
        has = np.zeros((m, 4096), np.float32)
        has[own[a:b], col[a:b] - lo] = 1
        out += (has @ has.T).astype(np.int32)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the edges between the nodes a and b join two trees, taken in order: a spanning forest of all of them."""
    up: dict[int, int] = {}

    def find(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    out = []
    _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
    for i in first.tolist():
        x, y = find(int(a[i])), find(int(b[i]))
        if x != y:
            up[x] = y
            out.append(i)
    return out


def across(members: DataFrame, sets: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of uids that connect the same groups as all similar pairs of one bucket from different groups.

    members: k (bucket), uid, n (different shingles), root (group), c and w (members and shingles of the bucket). Each two
    blocks of a bucket meet in one place, where all pairs are compared without becoming rows and a spanning forest over
    groups is returned. Pairs in several buckets count in the first.
    """

    def pairs(k: int, apart: bool, rows: list[tuple]):
        uids, n, root, side = (np.array([r[i] for r in rows]) for i in range(4))
        keys = np.stack([np.frombuffer(r[5], np.int64) for r in rows])
        fit = (root[:, None] != root) & (uids[:, None] < uids) & (np.minimum(n[:, None], n) >= least * np.maximum(n[:, None], n))
        if apart:
            fit &= side[:, None] != side
        i, j = np.nonzero(fit)
        first = np.concatenate([np.empty(0, np.int64), *((keys[i[s : s + 65536]] == keys[j[s : s + 65536]]).argmax(axis=1) for s in range(0, len(i), 65536))])
        mine = keys[i, first] == k
        i, j = i[mine], j[mine]
        if len(i):
            both = _common([np.frombuffer(r[4], np.uint64) for r in rows])[i, j]
            keep = both >= least * (n[i] + n[j] - both)
            i, j = i[keep], j[keep]
        if len(i):
            some = _forest(root[i], root[j])
            i, j = i[some], j[some]
        return uids[i], uids[j]

    def run(batches):
        at, rows = None, []
        for b in (x for batch in batches for x in blocks([batch], 4 << 20)):
            out = []
            for k, p, q, *row in zip(*(b.column(c).to_pylist() for c in ("k", "p", "q", "uid", "n", "root", "side", "h", "keys")), strict=True):
                if (k, p, q) != at:
                    if len(rows) > 1:
                        out.append(pairs(at[0], at[1] != at[2], rows))
                    at, rows = (k, p, q), []
                rows.append(row)
            yield batch_of(out)
        yield batch_of([pairs(at[0], at[1] != at[2], rows)] if len(rows) > 1 else [])

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *(o[x] for o in out)])) for x in (0, 1)], names=["a", "b"])

    parts = F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
    dealt = members.withColumn("m", parts).withColumn("side", F.pmod(F.xxhash64("uid"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("k", F.least("side", "o").alias("p"), F.greatest("side", "o").alias("q"), "uid", "n", "root", "side")
    met = dealt.join(sets, "uid").repartition("k", "p", "q").sortWithinPartitions("k", "p", "q")
    return met.mapInArrow(run, "a long, b long")


def near_duplicate_links(docs: DataFrame, size: int = 5, least: float = 0.8, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of similar texts that connect the same groups as all that are proposed; docs has uid (distinct) and text.

    Proposed are texts whose SimHash fingerprints lie within `radius` bits (covering LSH, see `links`), and texts that
    share a bucket of least shingle hashes, which also meet where fingerprints lie further apart. Both come from one
    reading of the texts and from the shingles that are compared. Whole texts decide.
    """
    prints = written(profiles(docs, size), "profiles")
    nodes = written(prints.groupBy("fp").agg(F.min("uid").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    same = prints.select("uid", "fp").join(nodes.filter("n > 1"), "fp").filter("uid <> least").select(F.col("least").alias("a"), F.col("uid").alias("b"))
    near = links(nodes.select("fp"), radius)
    near = near.join(nodes.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    close = written(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(same), "close")
    keyed = prints.select("uid", "n", F.explode("keys").alias("k"))
    heads = written(keyed.groupBy("k").agg(F.min("uid").alias("head"), F.max("uid").alias("last"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")).filter("head <> last"), "heads")
    shared = written(keyed.join(heads.select("k", "head", "c", "w"), "k"), "shared")
    wanted = written(shared.select("uid").unionByName(close.select(F.col("a").alias("uid"))).unionByName(close.select(F.col("b").alias("uid"))).distinct(), "wanted")
    sets = written(shingled(docs.join(wanted, "uid", "left_semi"), size), "sets")
    # every member of a bucket with its first, and what the fingerprints propose
    first = shared.filter("uid <> head").select(F.col("head").alias("a"), F.col("uid").alias("b")).unionByName(close).distinct()
    edges = written(similar(first, sets, least), "links")
    groups = components(edges).select(F.col("node").alias("uid"), "root")
    # then what is left: pairs of a bucket that are not yet in one group; in a bucket of two the only pair was compared
    placed = written(shared.filter("c > 2").join(groups, "uid", "left").select("k", "uid", "n", "c", "w", F.coalesce("root", "uid").alias("root")), "placed")
    mixed = placed.groupBy("k").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("k")
    rest = written(across(written(placed.join(mixed, "k"), "open"), sets, least, block), "rest")
    discard(prints, nodes, close, heads, shared, wanted, sets, placed)
    return edges.unionByName(rest)


def without_near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: of each group linked by similar texts the smallest id stays.

    Two texts are near duplicates if their sets of `size`-word shingles have a Jaccard similarity of `least` or more, and
    groups are the components of all such pairs that are proposed (see `near_duplicate_links`); so no text goes that has
    no similar one. Whether a pair shares a bucket of least shingle hashes depends on its similarity alone, not on where
    the texts differ: at 0.8 it misses all of them with probability (1 - 0.8^ROWS)^BANDS, about one in eight million, and
    above with less. A bucket's members are compared with its first, then all its pairs that this left in different
    groups, so none is lost to a failed proposal and members of one group cost as much as there are of them.

    Texts without words, null ones included, are alike. Ids may be of any type, repeat or be null (a null id stays only if
    its group has no other): rows are told apart by id and text, and of rows that repeat both one stays at most. Columns of
    any name are kept. An empty table gives no row.
    """
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    parts = [F.col(key), F.col(key).isNull(), F.col(text), F.col(text).isNull()]
    flat = flat.withColumn("uid", F.xxhash64(*parts)).withColumn("check", F.xxhash64(F.lit(1), *parts))
    twice = written(flat.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi")).filter("n > 1"), "twice")
    repeated = not twice.isEmpty()
    d = flat.select("uid", F.col(key).alias("id"), F.col(text).alias("text"))
    if repeated:  # different rows of one hash take no part; the same row takes part once
        d = d.join(twice.filter("lo <> hi").select("uid"), "uid", "left_anti").dropDuplicates(["uid"])
    groups = components(near_duplicate_links(d.select("uid", "text"), size, least, radius, block)).withColumnRenamed("node", "uid")
    placed = d.select("uid", "id").join(groups, "uid").withColumn("rank", F.struct(F.col("id").isNull().alias("none"), "id", "uid"))
    drop = written(placed.join(placed.groupBy("root").agg(F.min("rank").alias("stays")), "root").filter("uid <> stays.uid").select("uid"), "dropped")
    out = flat.join(drop, "uid", "left_anti")
    if repeated:
        out = out.dropDuplicates(["uid", "check"])
    return out.drop("uid", "check").toDF(*names)
