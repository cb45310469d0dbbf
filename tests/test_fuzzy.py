"""The partial-ratio join against all pairs, each pair against all windows."""

import random

import pytest

from weftlight.operators.fuzzy import names_in_texts, partial_ratio, seeds


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain(a, b):
    if not a or not b:
        return float(a == b)
    best = 0.0
    for s, t in ((a, b), (b, a)):
        if len(s) <= len(t):
            windows = [t[i : i + len(s)] for i in range(len(t) - len(s) + 1)] + [t[:i] for i in range(1, len(s))] + [t[-i:] for i in range(1, len(s))]
            best = max([best, *(2 * lcs(s, w) / (len(s) + len(w)) for w in windows)])
    return best


def words(rng, n, letters="abcdé 日"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_ratio_equals_all_windows():
    rng = random.Random(1)
    for _ in range(400):
        a, b = words(rng, rng.randrange(1, 12)), words(rng, rng.randrange(1, 30))
        assert partial_ratio(a, b) == pytest.approx(plain(a, b)) == partial_ratio(b, a)
    long = words(rng, 70)
    assert partial_ratio(long, words(rng, 9) + long[:30] + "x" + long[30:] + words(rng, 9)) == pytest.approx(plain(long, long[:30] + "x" + long[30:]), abs=0.02)
    assert partial_ratio("", "") == 1 and partial_ratio("", "a") == 0 and partial_ratio("york", "in new york city") == 1


@pytest.mark.parametrize("least", [0.6, 0.75, 0.8, 0.9, 1.0])
def test_the_bound_on_shared_grams_holds(least):
    rng = random.Random(2)
    for _ in range(1500):
        s = words(rng, rng.randrange(1, 14), "abc")
        t = list(words(rng, rng.randrange(0, 4), "abc") + s + words(rng, rng.randrange(0, 4), "abc"))
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(t))
            t[i : i + 1] = [rng.choice("abcx")] * rng.choice((0, 1, 2))
            t = t or ["x"]
        t = "".join(t)
        if len(s) <= len(t) and plain(s, t) >= least - 1e-9:
            q, c = seeds(len(s), least)
            assert sum(s[i : i + q] in t for i in range(len(s) - q + 1)) >= c


@pytest.mark.parametrize("least", [0.6, 0.8, 0.92])
def test_join_equals_all_pairs(spark, least):
    rng = random.Random(3)
    vocabulary = [words(rng, rng.randrange(2, 9), "abcdefgh") for _ in range(25)]
    names = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 4)))) for i in range(60)] + [(90, None), (91, ""), (92, "A"), (93, "X" * 80), (94, "New York"), (94, "new york")]
    texts = []
    for i in range(60):
        t = list(" ".join([rng.choice(vocabulary) for _ in range(rng.randrange(0, 6))] + [rng.choice(names[:60])[1]]))
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = rng.choice("abz ")
        texts.append((i, "".join(t)))
    texts += [(80, None), (81, ""), (82, "a"), (83, "x" * 79 + "y" + "x" * 30), (84, "flights to NEW  YORK today"), (84, "b")]
    got = sorted((r["id"], r["key"], round(r["likeness"], 6)) for r in names_in_texts(spark.createDataFrame(names, "id long, name string"), spark.createDataFrame(texts, "key long, text string"), least).collect())
    want = sorted((i, k, round(p, 6)) for i, n in names for k, t in texts if n is not None and t is not None and (p := plain(n.lower(), t.lower())) >= least - 1e-9)
    assert got == want and len(want) > 50


def test_query_gives_rows(spark):
    from weftlight.plans import catalogue

    rows = catalogue.QUERIES["names_in_questions"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 20 and all(0.8 <= r["likeness"] <= 1 for r in rows) and any(r["likeness"] < 1 for r in rows)
