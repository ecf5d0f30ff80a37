import random
from itertools import product

import pytest

from tidemark.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home page"><header><h1>Site</h1><nav><ul><li><a href=/>Home</a></ul></nav></header>
<div id="cookie-notice">We use cookies. Accept them all please, thanks.</div><main><article><header><h2>A title</h2></header><p>First &lt;ok&gt; para\n  of&nbsp;it&#33;<p>Second <b>para</b><br>goes on.
<ul><li>One thing<li>Two</ul><aside>Related: buy this.</aside><div class="ad">Buy now, it is good.</div><!-- x --><p>End.</article>
<section class="comments"><h3>Comments</h3><p>I like it very much, thank you for the work you did. And more.</p></section></main>
<div class="sidebar"><p>Popular posts are listed here for you.</p></div><form>Name <input> <button>Send</button></form><footer>&copy; me</footer><script>x="<p>no</p>"</script></body></html>"""


def test_article_alone(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<article><p>Cut off &am"), (5, "u", "<p>A page without an article, in a plain paragraph.<p><a href=x>link</a>"), (6, "u", "<article><h1>Cut</h1><p>text</p><fo"), (6, "u", "plain words"), (7, "u", "<article>" + "<p>para graph.</p>" * 3000)]
    got = {}
    for r in h.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))).collect():
        got.setdefault(r.page_id, []).append(r)
    assert got[1][0].text == "A title\n\nFirst <ok> para of it!\n\nSecond para goes on.\n\nOne thing\n\nTwo\n\nEnd."
    assert got[2][0].text == "" and got[3][0].text == "" and got[2][0].n_chars == 0 and got[3][0].url is None
    assert got[4][0].text == "Cut off &am" and got[5][0].text == "A page without an article, in a plain paragraph."
    assert sorted(r.text for r in got[6]) == ["Cut\n\ntext", "plain words"]
    assert got[7][0].n_content == 3000 and all(r.n_chars == len(r.text) for rs in got.values() for r in rs)


def test_cut_is_least():
    r = random.Random(4)
    for _ in range(40):
        n = r.randint(1, 7)
        terminals = [(r.randint(0, 9), r.randint(0, 9)) for _ in range(n)]
        edges = [(a, b, r.randint(1, 6)) for a in range(n) for b in range(a) if r.random() < 0.5]
        cost = lambda s: sum(t[1] if x else t[0] for x, t in zip(s, terminals)) + sum(c for a, b, c in edges if s[a] != s[b])  # noqa: B023, E731
        assert cost(h.min_cut(terminals, edges)) == min(cost(s) for s in product((True, False), repeat=n))


def test_empty_table(spark):
    assert h.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def said(page):
    return "\n\n".join(h.main_blocks(page)[0])


def test_scripts_quotes_and_maths():
    assert said("<article><p>One.</p><script>for(i=0;i<n;i++){ // don't stop\n}</script><p>Two is here.</p><p>It's three.</p></article>") == "One.\n\nTwo is here.\n\nIt's three."
    assert said("<article><p title=don't>A first.</p><p>It's a second.</p></article>") == "A first.\n\nIt's a second."
    assert said("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></article>") == "Let x=2 hold."
    assert said("<article><object><p>Words in an object.</p></object><canvas>And some in a canvas.</canvas><p a='>' b=\"<p>\" c>End.</p></article>") == "Words in an object.\n\nAnd some in a canvas.\n\nEnd."
    assert said("<article><style>p>a{}</style  ><p>Kept<SCRIPT src=x></SCRIPT></p><script>never closed <p>no</p>") == "Kept"


PROSE = "The council met on Monday to hear what the engineers had found, and it agreed to pay for all of the work. "


def test_names_are_evidence_and_no_rule():
    assert said(f'<article><p>{PROSE}</p><div class="legal"><p>{PROSE * 3}</p></div><div class="post-tags search"><p>{PROSE * 2}</p></div><div class="ad">Buy it now.</div></article>').count("council") == 6
    for name in ("content-sidebar-wrap", "site has-sidebar", "layout with-sidebar", "page-header-image content", "no-comments post", "menu-open page"):
        assert said(f'<body><div class="{name}"><article><h1>A title</h1><p>{PROSE}</p></article><div class="sidebar"><p>Popular posts are listed.</p></div></div></body>') == "A title\n\n" + PROSE.strip()
    assert said(f'<main><p>{PROSE}</p><section class="comments"><article><p>{PROSE * 20}</p></article></section></main>') == PROSE.strip()


def test_neighbours_decide():
    page = f"<article><p>{PROSE}</p><p>So.</p><p>{PROSE}</p></article>"
    found, nodes = h.parsed(page)
    content, boiler = h.costs(found, nodes)[1]
    texts, n, swayed = h.main_blocks(page)
    assert content < boiler and texts[1] == "So." and n == 3 and swayed == 1
    assert said("<article><p>So</p></article>") == "So"  # a short article too


def test_deep_nesting():
    n = 50_000
    for open_, close in (("<div>x", "</div>"), ("<foo><li>x", "</foo>"), ("<b><p>x", "</b>"), ("<article><div>x", "")):
        texts, blocks, _ = h.main_blocks("<article>" + open_ * n + close * n)
        assert blocks == n and len(texts) == n


def test_generated_pages():
    """Pages of known articles under all sorts of wrappers, chrome and damage."""
    r = random.Random(9)
    words = "river stone council paper window garden engine letter market winter bridge carpet signal harbour".split()
    prose = lambda a, b: " ".join(r.choices(words, k=r.randint(a, b))).capitalize() + "."
    for _ in range(300):
        parts, html_ = [], []
        for _ in range(r.randint(1, 9)):
            text = prose(1, 60)
            kind = r.choice(["p", "li", "h2", "quote", "cell", "bare"])
            shown = text.replace(" ", r.choice([" ", "\n  ", "&nbsp;", " <b>", "</b> "]), 1)
            html_.append({"p": f"<p class=x title='a>b'>{shown}" + r.choice(["</p>", ""]), "li": f"<ul><li>{shown}</ul>", "h2": f"<h2>{shown}</h2>", "quote": f"<blockquote><p>{shown}</blockquote>", "cell": f"<table><tr><td>{shown}</table>", "bare": f"<div>{shown}</div>"}[kind])
            parts.append(" ".join(text.split()))
            html_.append(r.choice(["", "<!-- <p>no</p> -->", "<script>a<b;'</script>", "<aside>Read this too.</aside>", '<div class="advert">Buy one now.</div>', "<form><label>Name</label><input></form>"]))
        wrap = r.choice(["", "<main>", "<div class='content has-sidebar'>", "<section id=page-wrap>"])
        before = r.choice(["", "<nav><a href=/>Home</a> <a href=/b>All</a></nav>", "<header><h1>The site</h1></header>", "<div id=cookie-notice><p>We use cookies, as you know.</p></div>"])
        after = r.choice(["", "<footer>&copy; us</footer>", f'<section class="comments"><p>{prose(5, 80)}</p></section>', '<div class="sidebar"><ul><li><a href=/x>Other</a></ul></div>'])
        got = said(f"<html><head><title>T</title></head><body>{before}{wrap}<article>{''.join(html_)}</article>{after}</body></html>")
        assert got == "\n\n".join(parts)


TEN = [f"Paragraph {k} of the article says what {PROSE.lower()}" for k in range(10)]


@pytest.mark.parametrize("n", [10, 2])
@pytest.mark.parametrize(
    "block",
    [
        "<div class='cookieBanner'><p>We use cookies to make this site work for you.</p></div>",
        "<div id='google_ads_iframe'><p>Advertisement: buy the best engine of the year, today only.</p></div>",
        "<div class='user-discussion'><h2>3 Comments</h2><p>Bob says that all of this is wrong and he knows it.</p></div>",
        "<div><h3>2 comments</h3><p>Bob says that all of this is wrong and he knows it.</p><p>Ann agrees with him, and so do we all, at length.</p></div>",
        "<div class='newsletter'><p>Sign up to our letter for more of the same news, every week, and never miss another story that we write for you, our dear readers.</p></div>",
        "<div class='advert'><p>Buy one now, for less than ever before, and get a second one that you do not need for no more than the price of the first one.</p></div>",
        "<noscript><p>Please enable JavaScript to read this page.</p></noscript>",
    ],
)
def test_blocks_of_others_inside_an_article(n, block):
    shown = [f"<p>{p}</p>" for p in TEN[:n]]
    want = "\n\n".join(" ".join(p.split()) for p in TEN[:n])
    for at in {n, n // 2, 1}:
        assert said("<article>" + "".join(shown[:at]) + block + "".join(shown[at:]) + "</article>") == want


@pytest.mark.parametrize("n", [10, 2])
def test_lists_of_links_by_their_place(n):
    shown = [f"<p>{p}</p>" for p in TEN[:n]]
    prose = [" ".join(p.split()) for p in TEN[:n]]
    links = "<ul><li><a href=/a>First report</a></li><li><a href=/b>The second report of the council</a></li><li><a href=/c>Data</a></li></ul>"
    items = ["First report", "The second report of the council", "Data"]
    at = n // 2
    assert said("<article>" + "".join(shown[:at]) + links + "".join(shown[at:]) + "</article>") == "\n\n".join(prose[:at] + items + prose[at:])
    assert said("<article>" + "".join(shown) + "<h2>Sources</h2>" + links + "</article>") == "\n\n".join(prose + ["Sources"] + items)
    for menu in (f"<nav>{links}</nav>", f"<div class='related-links'>{links}</div>", f"<aside>{links}</aside>"):
        assert said("<article>" + "".join(shown[:at]) + menu + "".join(shown[at:]) + "</article>") == "\n\n".join(prose)


def test_names_that_are_content():
    for wrap in ("<div class='adsorption-study'>", "<section id='discussion'>", "<div class='content-sidebar-wrap'>", "<div id='thread-safety'>"):
        assert said(f"<article>{wrap}<h2>On it</h2><p>{PROSE}</p></div></section></article>") == "On it\n\n" + " ".join(PROSE.split())
