import random
import re
from collections import Counter

import pytest

from weftlight.llm import phrases
from weftlight.llm.phrases import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, top, inside=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {g: x for g, x in f.items() if x >= least}
    out = {}
    for (lang, g), a in f.items():
        if len(g) < 2 or any(m == lang and len(h) > len(g) and 100 * x >= inside * a and any(h[i : i + len(g)] == g for i in range(len(h))) for (m, h), x in f.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "é", "Straße", "n b", "日本", "x1", "a-b", "\x01", "𝒳"]
    rows = [(None, "en"), ("", None), (" \t ", "en"), (".,;:!?\n\r\x0b\x0c", "de"), ("One", "xx")]
    for _ in range(n):
        text = "".join(rng.choice(words[: rng.choice((2, 4, 12))]) + rng.choice((" ", " ", " ", "\t", "  ", ", ", "\n", ".")) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(("en", "de", None, "und"))))
    return rows + rows[:40]


@pytest.mark.parametrize(("least", "longest", "top", "hot"), [(30, 4, 2000, 0), (3, 4, 7, 20), (2, 6, 40, 0), (5, 3, 2000, 1)])
def test_equals_brute_force(spark, monkeypatch, least, longest, top, hot):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 2000)
    if hot:
        monkeypatch.setattr(phrases, "HOT_PAIRS", hot)
    rows = made(least, 160)
    docs = spark.createDataFrame([(*r, i, 7) for i, r in enumerate(rows)], "text string, lang string, word int, n int").repartition(5)
    assert got(collocations(docs, least, longest, top)) == plain(rows, least, longest, top)


def test_one_long_text_and_a_hot_phrase(spark):
    rows = [("a b c d " * 60_000, "en")] + [("Terms of use apply.", "fr")] * 3000
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert got(collocations(docs)) == plain(rows, 30, 4, 2000)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations(docs).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("... !", "en"), ("single", "en")], docs.schema), least=1).count() == 0


def test_a_pair_of_a_block_is_one_row(spark):
    docs = spark.createDataFrame([("of the", "en")] * 5000, "text string, lang string").coalesce(1)
    blocks = phrases.word_blocks(docs, "text", "lang")
    assert blocks.count() == 1
    named = blocks.selectExpr("block", "seq", "array(10L, 20L) as names")
    assert [(r["left"], r["right"], r["n"]) for r in phrases.pair_counts(named).collect()] == [(10, 20, 5000)]
