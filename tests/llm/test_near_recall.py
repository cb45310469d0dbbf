import itertools
import random

import xxhash

from weftlight.llm.pretokens import Cache
from weftlight.llm.simhash import shingle_codes, shingle_set, without_near_duplicates


def smallest(rows):
    """Smallest ids of the groups of all pairs with a Jaccard similarity of 0.8 or more."""
    sets, root = {d: shingle_set(t, 5) for d, t in rows.items()}, {d: d for d in rows}
    for a, b in itertools.combinations(rows, 2):
        both = len(sets[a] & sets[b])
        if root[a] != root[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            old, new = sorted((root[a], root[b]), reverse=True)
            root = {d: new if r == old else r for d, r in root.items()}
    return set(root.values())


def test_hashed_shingles_equal_plain_ones():
    codes = Cache(lambda w: xxhash.xxh64_intdigest(w, 42), 100)
    for text in ("", "one", "a b c d e", "A B c d E f", "a b c d e a b c d e a b", " \t\n"):
        assert len(shingle_codes(text, 5, codes)) == len(shingle_set(text, 5))
    x, y = (shingle_codes(t, 5, codes) for t in ("a b c d e f g", "b c d e f g h"))
    assert len(set(x.tolist()) & set(y.tolist())) == 2


def left(spark, rows, **how):
    docs = spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")
    return {r["doc_id"] for r in without_near_duplicates(docs, **how).collect()}


def test_appended_removed_and_edited_copies_are_all_met(spark):
    rng = random.Random(5)
    for kind in ("appended", "removed", "edited"):
        rows = {}
        for i in range(120):
            n = rng.choice((30, 60, 200, 400))
            text = [f"w{rng.randrange(5000)}" for _ in range(n)]
            copy = list(text)
            if kind == "edited":
                for _ in range(max(1, n // 60)):
                    copy[rng.randrange(n)] = "changed"
            else:
                copy += [f"foot{i}x{j}" for j in range(int(n * rng.uniform(0.05, 0.2)))]
            pair = (copy, text) if kind == "removed" else (text, copy)
            rows[2 * i], rows[2 * i + 1] = (" ".join(x) for x in pair)
        want = smallest(rows)
        assert len(want) < 150
        assert left(spark, rows) == want, kind


def test_small_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert left(spark, rows) == smallest(rows)


def test_a_group_of_near_copies_loses_no_link(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = {}
    for i in range(500):
        text = list(base)
        for _ in range(rng.randrange(9)):
            text[rng.randrange(300)] = f"e{rng.randrange(10**6)}"
        rows[i] = " ".join(text)
    want = smallest(rows)
    assert 20 < len(want) < 300
    assert left(spark, rows, block=64) == want
