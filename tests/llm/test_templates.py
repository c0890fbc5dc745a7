"""Main texts of pages against a plain rule for the given ones, and pages of other makes."""

import html
import random
import re
import time
from collections import defaultdict

import pytest

from driftloom.llm import templates
from driftloom.llm.queries import op4_template_removal


def plain(page):
    """The given pages' one article holds headings and paragraphs only."""
    article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>|<[^>]*$", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_given_pages(spark, size):
    folder = f"/root/testdata/{size}"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op4_template_removal(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], plain(pages[r["page_id"]]["html"]), len(r["text"]))


def test_rules_of_one_page():
    page = """<body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
    <main><article><header><h1>The   title</h1></header><p>One &amp; two<p>three <b>bold</b>
    text<br>goes on <div class="share">Share this</div><form><label>Mail</label></form>
    <ul><li>a<li>b</ul><script>if (a < b) "</p>"</script><!-- no --><blockquote>said &lt;so&gt;</blockquote>
    <section class="comments"><p>first!</p></section></article></main>
    <aside>More</aside><footer>(c)</footer></body>"""
    assert templates.main_text(page) == "The title\n\nOne & two\n\nthree bold text goes on\n\na\n\nb\n\nsaid <so>"
    assert templates.main_text("just text") == "just text"
    assert templates.main_text("<form><main><p>kept</p></main></form><p>no") == "kept"
    assert templates.main_text("<p title='it's'>odd</p> <a href=\"x>cut") == "odd\n\ncut"
    assert templates.main_text("") == templates.main_text("<p>") == templates.main_text("<!-- x") == ""


def test_wrappers_around_the_text():
    side = '<div class="sidebar">Side words</div>'
    for wrapper in ('<div class="content-sidebar-wrap">', '<div class="has-sidebar">', '<div id="page" class="with-menu">', '<section role="banner">', "<form>"):
        close = "</" + wrapper[1:].split()[0].strip(">") + ">"
        for tag in ("main", "article"):
            assert templates.main_text(f"<body>{wrapper}{side}<{tag}><p>The whole text</p></{tag}>{close}<footer>(c)</footer></body>") == "The whole text"
    bare = '<body><div id="page" class="with-menu"><div class="menu"><a href="/">Home</a> <a href="/a">All about the shop</a></div><p>The whole text</p></div><footer>(c)</footer></body>'
    assert templates.main_text(bare) == "The whole text"
    for tag in ("main", "article"):
        assert templates.main_text(f'<{tag}><div class="has-sidebar">{side}<p>The whole long text</p></div></{tag}>') == "The whole long text"
        assert templates.main_text(f'<{tag}><p>The whole text</p><div class="comments">First of all comments!</div></{tag}>') == "The whole text"
    # What is no wrapper of the text goes as before.
    related = '<div class="related"><article>Teaser</article><article>Other</article></div>'
    assert templates.main_text(f"<article><p>The whole text</p></article>{related}") == "The whole text"
    assert templates.main_text(f"<main><p>The whole text</p>{related}</main>") == "The whole text"


def test_all_articles_or_the_larger_main():
    several = "<article><p>First part</p></article><p>x</p><article><p>Second</p><article>Inner</article></article>"
    assert templates.main_text(f"<body>{several}</body>") == templates.main_text(f"<main>{several}</main>") == "First part\n\nSecond\n\nInner"
    assert templates.main_text("<main><p>The text of the page</p></main><article>Teaser</article>") == "The text of the page"
    assert templates.main_text("<main><p>The text of the page</p><article>Teaser</article></main>") == "The text of the page\n\nTeaser"
    assert templates.main_text("<body><p>The text of the page</p><article>Teaser</article></body>") == "The text of the page\n\nTeaser"
    assert templates.main_text("<main>Note</main><article>The text of the page</article>") == "Note\n\nThe text of the page"


def test_subtrees_that_a_host_repeats(spark):
    bar = '<div class="x7"><span>Menu of this site</span></div>'
    rows = [(i, f"https://one.example/{i}", f"<body>{bar}<div><p>Text {i % 17} of page</p></div></body>") for i in range(40)]
    rows += [(100 + i, f"https://two.example/{i}", f"<body>{bar}<div><p>Other {i}</p></div></body>") for i in range(3)]
    rows += [(200, None, None), (201, "no url", ""), (None, "https://one.example/x", "<p>alone</p>"), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, hashes int").repartition(4)
    got = sorted(((r["page_id"], r["text"]) for r in templates.extract(frame).collect()), key=str)
    # Pages of "one" that show the same text are copies; seventeen different pages share the bar.
    want = [(i, f"Text {i % 17} of page") for i in range(40)] + [(0, "Text 0 of page")]
    want += [(100 + i, f"Menu of this site\n\nOther {i}") for i in range(3)]
    want += [(200, ""), (201, ""), (None, "alone")]
    assert got == sorted(want, key=str)
    assert templates.extract(frame.limit(0)).count() == 0


def test_designs_of_a_host_and_small_hosts(spark):
    bars = [f'<div class="x{k}"><span>Menu of design {k}</span></div>' for k in range(3)]
    rows = [(i, "https://many.example/", f"<body>{bars[i % 3]}<div><p>Text {i} of page</p></div></body>") for i in range(60)]
    rows += [(100 + i, "https://small.example/", f"<body>{bars[0]}<div><p>Text {i} of page</p></div></body>") for i in range(5)]
    # One article with small edits, on a few of the pages: a near copy, not a template.
    rows += [(200 + i, "https://many.example/", f"<body>{bars[0]}<article><p>The article that is shown again</p><p>by {i}</p></article></body>") for i in range(10)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in templates.extract(frame).collect()}
    want = {i: f"Text {i} of page" for i in range(60)} | {100 + i: f"Text {i} of page" for i in range(5)}
    assert got == want | {200 + i: f"The article that is shown again\n\nby {i}" for i in range(10)}


def test_nothing_of_an_article_goes_for_its_words(spark):
    """Words, headings and paragraphs that all pages of a host share are text all the same."""
    rows = []
    for i in range(40):
        body = f"<h2>Introduction</h2><p>Before use {i}, you must <em>not</em> open valve {i % 7}.</p><p>Mind the <b>pressure</b>.</p><div>Always the same</div><h2>References</h2><ul><li>One</li></ul><p>Seen {i * i}</p>"
        rows.append((i, f"https://one.example/{i}", f"<body><nav><a href=/>Home</a></nav><article><h1>Page {i}</h1>{body}<div class=k9><p>Our shop is open</p><p>every day</p></div></article></body>"))
    got = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == {
        i: f"Page {i}\n\nIntroduction\n\nBefore use {i}, you must not open valve {i % 7}.\n\nMind the pressure.\n\nAlways the same\n\nReferences\n\nSeen {i * i}" for i in range(40)
    }


def test_counting_against_plain_rules(spark):
    rng = random.Random(11)
    parts = [f"<div class=x{k}><p>Part {k}</p></div>" for k in range(6)] + ["<ul><li><a>a</a><li><a>b</a></ul>", "<p>Line</p>", "<section>S <b>x</b></section>"]
    rows = []
    for i in range(250):
        host = rng.choice(["hot", "hot", "hot", "b", "c", "d"])
        inside = "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))
        rows.append((i, f"https://{host}.example/{i % 90}", f"<body>{inside}<div><p>Own {i % 120}</p></div></body>"))
    rows += [(900, "https://few.example/", rows[0][2]), (901, None, rows[1][2]), (902, None, None)]
    pages, want = defaultdict(set), {}
    for _, url, source in rows:
        page = templates.parse(source or "")
        pages[url.split("/")[2] if url else ""].add((page.design, "".join(p for p, _ in page.pieces), frozenset(templates.candidates(page))))
    for host, own in pages.items():
        groups = {templates.WHOLE: own}
        for design in {d for d, *_ in own}:
            members = {x for x in own if x[0] == design}
            if len(members) >= templates.DESIGN_SHARE * len(own):
                groups[design] = members
        for design, members in groups.items():
            for mark in set().union(*(x[2] for x in members)):
                n = sum(mark in x[2] for x in members)
                if n >= templates.LEAST_PAGES and 2 * n > len(members):
                    want.setdefault(host, set()).add((design, mark))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["host"]: {(x["design"] % (1 << 64), x["hash"] % (1 << 64)) for x in r["templates"]} for r in templates.host_templates(frame).collect()}
    assert got == want and len(want["hot.example"]) > 3


def test_deep_nesting_is_read_in_one_pass():
    def seconds(n):
        start = time.process_time()
        assert templates.main_text("<div><p>x" * n + "<p>last words") .endswith("last words")
        return time.process_time() - start

    seconds(1000)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.02)
