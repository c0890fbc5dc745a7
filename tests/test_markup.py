import pytest
from hypothesis import given
from hypothesis import strategies as st

from driftloom.functions import markup
from tests import pages

TEXT = (
    '<html><head><title>T &amp; x</title><script>var a="<p>"</script></head><body><div class="a b" id=main><p>one'
    '<p>two <b>bold</b> <br/>tail<ul><li>x<li>y</ul><span data-x=\'1\'>q > r</span></div><!-- c --><p class="z">end</body></html>'
)


@pytest.mark.parametrize(
    "selector,expected",
    [
        ("#main", "one two bold tail x y q > r"), (".b p", "one"), ("div > p", "one"), ("div > b", None), ("p b", "bold"),
        ("li", "x"), ('[data-x="1"]', "q > r"), ("span[data-x]", "q > r"), ("[class*=a]", "one two bold tail x y q > r"),
        ("[class^='z']", "end"), ("[class$=b]", "one two bold tail x y q > r"), ("p:nth-child(2)", "two bold tail"),
        ("li:nth-of-type(2)", "y"), (".z, .b", "one two bold tail x y q > r"), ("*.z", "end"), ("title", "T & x"),
        ("div#main.a", "one two bold tail x y q > r"), ("div#other", None), ("br", None),
        ("a:hover", None), ("!!", None), ("div >", None), ("", None), (None, None),
    ],
)
def test_selector(selector, expected):
    assert markup.extract_fields(markup.read_page(TEXT), {"x": selector, "y": "li"}) == {"x": expected, "y": "x"}


def test_designs():
    one, two = markup.read_page(pages.DESIGN_ONE), markup.read_page(pages.DESIGN_TWO)
    values = markup.extract_fields(one, pages.SELECTORS_ONE)
    assert values["description"] == "Boils fast. Steel body." and values["currency"] is None
    assert all(v is not None for k, v in values.items() if k != "currency")
    assert not any(markup.extract_fields(two, pages.SELECTORS_ONE).values())


def test_sections():
    filler = "<p>word</p>" * 60
    nav = "<nav>" + "<a>x</a>" * 400 + "</nav>"
    text = f"<html><head><title>t</title></head><body>{nav}<main><script>x</script>{filler}<div style='Display : NONE'>no</div></main></body></html>"
    cleaned, selector, section = markup.content_section(text, 15_000, 500)
    assert selector == "main" and section == f"<main>{filler}</main>" and "<title>" not in cleaned
    assert markup.content_section(text, 100, 500)[2] == section[:100] + "... [truncated]"
    short = "<html><body><main>short</main></body></html>"
    assert markup.content_section(short, 15_000, 500) == (short, None, short)
    product = f"<body><main>{filler}</main><div itemtype='http://x/Product'>{filler}</div></body>"
    assert markup.content_section(product, 15_000, 500)[1] == "[itemtype*='Product']"


@given(st.text(alphabet="<>/ab =\"'!-&;", max_size=80))
def test_never_raises(text):
    page = markup.read_page(text)
    assert all(i <= n.last < len(page.nodes) and n.start <= n.end for i, n in enumerate(page.nodes))
    markup.content_section(text, 50, 10)


def test_entities_and_blank_pieces():
    page = markup.read_page("<p>a&nbsp;b<i>&nbsp;</i> &lt;c&gt;<!-- x --> </p>tail &amp; end")
    assert page.text(0) == "a\xa0b <c>" and page.text(1) is None
    assert markup.read_page("only &amp; text").pieces == [(None, "only & text")]
