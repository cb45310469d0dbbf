import itertools
import random

import xxhash

from weftlight.llm.components import components
from weftlight.llm.simhash import covering_masks, links, near_duplicate_components, neighbour_links


def brute_fp(text, size=4):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    fps = {d: brute_fp(t) for d, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    return {d: (f"{fps[d]:016x}", c) for d, c in groups(pairs, fps).items()}


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(3)
    for r in (2, 4):
        masks = covering_masks(r)
        assert len(masks) == 2 ** (r + 1) - 1
        for _ in range(3000):
            d = sum(1 << i for i in rng.sample(range(64), r))
            assert any(m & d == 0 for m in masks)


def test_components_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(150)
    rows = [tuple(r) for r in docs.collect()] + [(9001, None), (9002, ""), (9003, "one two"), (9004, "ONE two"), (9005, " \n ")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    for bucket in (8192, 3):
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicate_components(df, bucket=bucket).collect()}
        assert got == brute(rows)
    assert near_duplicate_components(df.limit(0)).count() == 0


def test_links_of_dense_balls(spark):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for c in centre for _ in range(150)}
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    want = groups([(sign(a), sign(b)) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4], [sign(f) for f in fps])
    want = {frozenset(n for n in want if want[n] == r) for r in set(want.values())}
    df = spark.createDataFrame([(sign(f),) for f in fps], "fp long")
    for edges in (links(df, 4), links(df, 4, bucket=10), neighbour_links(df, 4)):
        root = {r["node"]: r["root"] for r in components(edges).collect()}
        root = {sign(f): root.get(sign(f), sign(f)) for f in fps}
        assert {frozenset(n for n in root if root[n] == r) for r in set(root.values())} == want


def test_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    got = components(df).collect()
    assert len(got) == 301 and len({r["root"] for r in got}) == 1
