"""Page texts of our own: two designs of one shop page, and small variations."""

DESIGN_ONE = """<!DOCTYPE html>
<html><head><title>Kettle</title><style>p {}</style></head>
<body><ul class="crumbs"><li><a href="/">Start</a></li><li><a href="/k">Kitchen</a></li></ul>
<form class="listing"><label id="ref">No. 88-K</label><b id="stock" class="badge ok">Available</b>
<fieldset><legend>Pay</legend><div id="cost">£64.50</div></fieldset></form>
<p id="about">Boils fast.<br>Steel body.</p>
<dl><dt>Liked</dt><dd id="stars">3.9 of 5</dd><dd id="tally">61 opinions</dd><dt>Made by</dt><dd id="maker">Harrow</dd></dl>
<h1 id="headline">Stove Kettle 2 l</h1></body></html>"""

DESIGN_TWO = """<!DOCTYPE html>
<html><head><title>Kettle</title></head>
<body><main class="offer"><p class="about">Boils fast.</p>
<section class="buy"><!-- price --><strong class="stock">Available</strong><small class="ref">No. 88-K</small></section>
<div class="panel"><h1 class="headline">Stove Kettle 2 l</h1><span class="amount">£64.50</span></div>
<em class="maker">Harrow</em><div class="scores"><i class="tally">61 opinions</i><i class="score">3.9 of 5</i></div></main></body></html>"""

SIMPLE = '<html><body><div class="a"><h1 id="t">x</h1><p class="z y">one</p></div></body></html>'
OTHER_TEXT = '<html><body><div class="a"><h1 id="t">quite other</h1><p class="y z">two</p></div></body></html>'
OTHER_PAGE = '<html lang="x"><table><tr><td>1</td><td>2</td></tr></table></html>'
# Removed elements inside one of their kind, and one that is never closed.
NESTED = '<p id="a">x</p><svg><g/><svg><path id="p1"/></svg><path id="p2"/></svg><p id="b">y</p><svg/><i id="c"></i><noscript><iframe><b id="n"></b></iframe></noscript><u id="d"></u><svg><svg></svg><b id="e">'

SELECTORS_ONE = {
    "title": "#headline",
    "price": "#cost",
    "currency": None,
    "in_stock": "#stock",
    "rating": "#stars",
    "review_count": "#tally",
    "sku": "#ref",
    "brand": "#maker",
    "description": "#about",
}
