import html as H
import itertools
import re

import numpy as np

from weftlight.llm import html as X

SF = "/root/testdata/sf0.001"


def plain(source):
    """Main text of the generated pages, whose articles are marked."""
    body = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
    body = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\n", body)))
    return "\n".join(t for t in (" ".join(H.unescape(x).split()) for x in body.split("\n")) if t)


def test_pages_table(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in df.collect()}
    got = {r["page_id"]: r for r in X.extract(df).collect()}
    assert len(got) == len(want)
    assert sum(got[i]["text"] == want[i] for i in want) >= 0.99 * len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_made_up_layouts_not_seen_in_training():
    x, y = X.labelled(150, seed=12345)
    assert (((X.model().logit(x) > 0) == (y > 0)).mean()) > 0.97


def test_boilerplate_of_a_page_is_left_out():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site name</h1></header>
    <nav><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
    <main><article><h1>Title &amp; more</h1><p>First   long paragraph, with text that goes on, and on.<p>Second one,\nbroken over lines.
    <script>document.write("<p>no</p>")</script></p></article></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=c>Other story</a></li></ul></aside>
    <section class="comments"><div class="comment">I do not agree with this at all, really.</div></section><form><input name=q><button>Go</button></form>
    <footer>&copy; 2024 Site</footer></body></html>"""
    assert X.main_text([page], X.model()) == ["Title & more\nFirst long paragraph, with text that goes on, and on.\nSecond one, broken over lines."]


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = 7
        parent = [-1, *[int(rng.integers(0, i)) for i in range(1, n)]]
        z = rng.normal(size=n)
        best = max(sum(z[i] for i in range(1, n) if k[i]) for k in itertools.product([0, 1], repeat=n) if k[0] and all(not k[i] or k[parent[i]] for i in range(1, n)))
        keep = X.decode(parent, z)
        assert keep[0] and all(not keep[i] or keep[parent[i]] for i in range(1, n))
        assert np.isclose(sum(z[i] for i in range(1, n) if keep[i]), best)


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text"), (4, "u", "<p>unclosed <b>bold"), (5, "u", "<" * 300), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<p a='x>y"), (1, "u", None), (None, "u", "<script>x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = X.extract(df).collect()
    assert len(got) == len(rows) and all(r["text"] is not None for r in got)
    assert X.extract(df.limit(0)).count() == 0


def test_letters_that_grow_in_lower_case_lose_no_text():
    trees = X.model()
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A {} title</h1>{}<script>var a = '</p>';</SCRIPT ><p>The article goes on with a sentence, and one more. It ends here.</p></article></body></html>"
    for n in (1, 400):
        body = "<p>This is a paragraph of the text, with a comma and a stop.</p>" * n
        plain, odd = X.main_text([page.format("Istanbul", body), page.format("İİİstanbul", body)], trees)
        assert "It ends here." in plain and odd == plain.replace("Istanbul", "İİİstanbul")


def test_pages_of_one_paragraph_are_whole():
    text = "This is a sentence of a paragraph, with a comma, which goes on for a while and then it stops. Another one follows."
    comments = '<section class="comments"><div class="comment">I do not agree with this at all, really.</div></section>'
    cases = ["<p>{}</p>", "<div class=content><p>{}</p></div>", "<body><div class=wrap><div class=entry><p>{}", "<div>{}</div>", "{}", comments + "<div class=entry><p>{}</p></div>", comments + "<p>{}</p>", "<nav><ul><li><a href=x>Home</a></li></ul></nav><p>{}</p><footer>&copy; Site</footer>"]
    assert X.main_text([c.format(text) for c in cases], X.model()) == [text] * len(cases)
    alone = [comments, "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>", "<footer>&copy; 2024 Site</footer>", "<div class=cookie-notice><p>We use cookies to improve your stay here.</p></div>"]
    assert X.main_text(alone, X.model()) == [""] * len(alone)
