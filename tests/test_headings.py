"""Heading scopes, sections and insertion against plain walks over lines."""

import random
import re

from pyspark.sql import functions as F

from weftlight.operators import headings

HEAD = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE)


def put(content, block, heading):
    content, block = content or "", (block or "").strip()
    if not heading:
        return content.rstrip() + "\n\n" + block + "\n"
    heads = [(m.start(), len(m[1]), m[2].strip().lower()) for m in HEAD.finditer(content)]
    own = next((h for h in heads if h[2] == heading.strip().lower()), None)
    if own is None:
        return content.rstrip() + "\n\n## " + heading.strip().lstrip("#").strip() + "\n\n" + block + "\n"
    cut = min((h[0] for h in heads if h[0] > own[0] and h[1] <= own[1]), default=len(content))
    return content[:cut].rstrip() + "\n\n" + block + "\n\n" + content[cut:].lstrip("\n")


def note(rng):
    return "\n".join(rng.choice(["# A", "## B", "### C b", "## a", "#### Deep ", "text", "more text", "", "#no heading", "  # indented", "### B", "#", "######  F", "####### seven"]) for _ in range(rng.randrange(14)))


def test_insertion_equals_the_plain_rule(spark):
    rng = random.Random(3)
    rows = [(i, note(rng).replace("#\n", "x\n"), rng.choice(["new", " new\nlines \n", None]), rng.choice(["A", "b", "C B", "missing", "## Missing", None, "", " deep "])) for i in range(400)]
    rows += [(900, None, "x", None), (901, "", "x", "A"), (902, "# A", "x", "a"), (903, "# A\n\n\n# B\n", "x", "A"), (904, "pre\n# A\nt\n## S\nu\n# B", "x", "A"), (905, "## A\n# A\nt", "x", "A"), (906, "y" * 100_000 + "\n# A\n" + "z" * 100_000, "x", "A")]
    df = spark.createDataFrame(rows, "id long, content string, block string, heading string")
    got = {r["id"]: r["out"] for r in df.select("id", headings.inserted(F.col("content"), F.col("block"), F.col("heading")).alias("out")).collect()}
    assert got == {i: put(c, b, h) for i, c, b, h in rows}


def walked(text):
    """(scopes, sections) of a text with one to three marks, by a stack."""
    heads, stack, runs = [], [], []
    for at, line in enumerate((text or "").split("\n")):
        line = line.strip(" ")
        m = re.match(r"(#{1,3}) (.*)", line)
        if m:
            level = len(m[1])
            stack = [s for s in stack if s[0] < level] + [(level, m[2].strip(" "))]
            heads.append((at, level, m[2].strip(" ")))
        elif line:
            path = " > ".join(t for _, t in stack) or None
            if runs and runs[-1][0] == path:
                runs[-1][1].append(line)
            else:
                runs.append((path, [line]))
    ends = [(a, lv, t, next((b for b, k, _ in heads if b > a and k <= lv), None)) for a, lv, t in heads]
    return ends, [(i, p, "\n".join(x)) for i, (p, x) in enumerate(runs, 1)]


def test_scopes_and_sections_equal_the_walk(spark):
    rng = random.Random(4)
    rows = [(i, note(rng)) for i in range(300)] + [(500, None), (501, "# only"), (502, "a\n\nb"), (503, "## B\nx\n### C\ny\n# A\nz\n### C\nq\n### C\nr")]
    lines = headings.marked_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {i: walked(t) for i, t in rows}
    got = {}
    for r in headings.scopes(lines).orderBy("doc_id", "at").collect():
        got.setdefault(r["doc_id"], []).append((r["at"], r["level"], r["title"], r["ends"]))
    assert got == {i: e for i, (e, _) in want.items() if e}
    got = {}
    for r in headings.sections(lines).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["path"], r["text"]))
    assert got == {i: s for i, (_, s) in want.items() if s}
