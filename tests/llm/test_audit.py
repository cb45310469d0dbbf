from itertools import permutations

from weftlight.llm.audit import filter_audit
from weftlight.llm.queries import ORACLE_SQL, QUERIES


def plain(docs, labels):
    """Every order walked row by row, as the definition has it."""
    rows, seen = [], {}
    for i, text, part in docs:
        text = text or ""
        if i is not None:
            seen[text] = min(seen.get(text, i), i)
        words = [w for w in text.translate({c: 32 for c in range(9, 14)}).split(" ") if w]
        fails = {f for f, x in zip("ABCD", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text)), strict=True) if x}
        rows.append((i, text, part or "", fails))
    for i, text, _, fails in rows:
        if i is not None and seen[text] < i:
            fails.add("E")
    out = {}
    for part in {r[2] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[2] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[3]]
                left = [r for r in left if f not in r[3]]
                mine = [r[3] for r in rows if r[2] == part and f in r[3]]
                lost = [sum(any(d == r[0] and r[0] is not None and v == 1 for d, v in labels[k]) for r in gone) for k in (0, 1)]
                out[part, "".join(order), step] = [len(left), len(gone), len(mine) - len(gone), sum(x == {f} for x in mine), *lost]
                shapley[f] += len(gone)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


LONG = " ".join(f"w{i}" for i in range(210))
ROWS = [(1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (3, None, None), (4, "", ""), (5, "A B\tC $", "a"), (6, "x " * 300, "a"), (None, LONG, "a"), (None, "", "c"), (7, LONG + " é#", "a"), (8, "X" * 70_000 + " y" * 70_000, "a"), (9, "\x0b\x0c a\r\nA", "c"), (0, " " * 5, "c")]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (5, None, 1), (None, 1, 1), (8, 1, 0), (4, 0, 1)]


def test_every_order_and_step_equals_the_plain_walk(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, source string, id int, digest string").repartition(3)
    labels = spark.createDataFrame([(*m, "t") for m in MARKS], "doc_id long, quality int, toxic int, part string")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit(docs, labels).collect()}
    assert got == plain(ROWS, [[(d, q) for d, q, _ in MARKS], [(d, t) for d, _, t in MARKS]])
    assert len(got) == 4 * 600


def test_empty_tables_and_no_labels(spark):
    docs = spark.createDataFrame([(i, "same text", None) for i in range(500)], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit(docs, none).filter("filter_order = 'EABCD'").orderBy("step").collect()
    assert [r["removed"] for r in rows] == [499, 1, 0, 0, 0] and [r["redundant"] for r in rows] == [0, 499, 0, 0, 0]
    assert sum(r["shapley"] for r in rows) == 120 * 500 and not any(r["good_lost"] or r["toxic_lost"] for r in rows)
    assert filter_audit(docs.limit(0), none).count() == 0


def test_sql_on_the_smallest_tables(spark):
    from tests.oracle import compare

    assert compare(spark, "op11_filter_audit", QUERIES["op11_filter_audit"], ORACLE_SQL["op11_filter_audit"], "/root/testdata/sf0.001") == ""
