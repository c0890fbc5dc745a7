import pytest
from pyspark.sql import functions as F

from driftloom.functions import keys, parsing, quality, responses
from driftloom.operators.extraction import typed_product

CASES = {
    parsing.parse_price: [
        ("£64.50", 64.5), ("8,064.50 EUR", 8064.5), ("$8.064.50", None), ("1.299,99", 1.29999),
        ("Only 5.", 5.0), ("v1.2 $3", 1.23), ("-5", 5.0), ("", None), ("free", None), (".", None), (None, None),
    ],
    parsing.parse_currency: [
        ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), (" usd ", "USD"), ("$645", "$64"),
        ("US Dollar", "US "), ("", None), ("\t\n", None), (None, None),
    ],
    parsing.parse_rating: [
        ("4.5 out of 5", 4.5), ("5", 5.0), ("0", 0.0), ("5.1", None), ("-1", None), ("Top 10: 4.5", None),
        ("4,7", 4.0), ("none", None), (None, None),
    ],
    parsing.parse_review_count: [
        ("(5,061 opinions)", 5061), ("1.2k", 12), ("none", None), ("", None), ("99999999999999999999", None), (None, None),
    ],
    parsing.parse_in_stock: [
        ("In Stock", True), ("OUT OF STOCK", False), ("Currently unavailable", False), ("sold out", False),
        ("Available", True), ("Add to Cart", True), ("buy now!", True), ("not available", True),
        ("out-of-stock", None), ("", None), (None, None),
    ],
}


@pytest.mark.parametrize("parser", CASES, ids=lambda p: p.__name__)
def test_parser(spark, parser):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES[parser])], "i int, raw string")
    got = [r[0] for r in df.orderBy("i").select(parser(F.col("raw"))).collect()]
    assert got == [expected for _, expected in CASES[parser]]


def test_text_is_stripped_then_cut(spark):
    df = spark.createDataFrame([(" \t abéd \n",), ("  ",), (None,)], "raw string")
    assert [r[0] for r in df.select(parsing.parse_text(F.col("raw"), 3)).collect()] == ["abé", "", None]


def test_white_space_is_what_python_strips(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert sorted(parsing.WHITE_SPACE) == sorted(spaces)
    texts = [f"{s}{s}a{s}é{s}" for s in spaces] + ["", "a", "é b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(parsing.strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_quality_and_typed_values_pass(spark):
    df = spark.createDataFrame(
        [({"title": "x", "price": "$5", "in_stock": "maybe"}, None, None), ({"price": "7"}, -5.0, True), ({}, None, None)],
        "raw map<string,string>, price_number double, in_stock_flag boolean",
    )
    rows = typed_product(df).collect()
    assert [(r.price, r.in_stock) for r in rows] == [(5.0, None), (-5.0, True), (None, None)]
    assert [r.confidence for r in rows] == [2 / 3, 2 / 3, 0.0]
    assert [r.null_rate for r in rows] == [7 / 9, 7 / 9, 1.0]


def test_map_measures(spark):
    df = spark.createDataFrame([({"title": "a", "price": None, "odd": "x"},), ({},)], "m map<string,string>")
    rows = df.select(
        quality.selector_coverage(F.col("m")), quality.result_null_rate(F.col("m")), quality.null_count(F.col("m")),
        F.map_keys(quality.known_fields(F.col("m"))), quality.validity_report(F.col("m")),
    ).collect()
    assert rows[0][0] == 1 / 9 and rows[0][1] == 1 / 3 and rows[0][2] == 1
    assert sorted(rows[0][3]) == ["price", "title"]
    assert rows[0][4]["title"].valid and not rows[0][4]["price"].valid and rows[0][4]["odd"].value == "x"
    assert rows[1][0] == 0.0 and rows[1][1] == 1.0


@pytest.mark.parametrize(
    "url,pattern",
    [
        ("https://a.com/x/?q=1#f", "a.com/x"),
        ("http://a.com/x", "a.com/x"),
        ("https://u:p@A.com:80/x;v=1", "u:p@A.com:80/x"),
        ("https://a.com/x;1/y", "a.com/x;1/y"),
        ("https://a.com/b c/", "a.com/b c"),
        ("https://a.com", "a.com"),
        ("/local/file.html", "/local/file.html"),
        ("//h/p//", "h/p"),
    ],
)
def test_url_pattern(spark, url, pattern):
    assert spark.createDataFrame([(url,)], "u string").select(keys.url_pattern(F.col("u"))).first()[0] == pattern


def test_responses(spark):
    texts = [
        '{"extracted": {"title": "T", "price": -5, "in_stock": true, "n": null}, "selectors": {"title": "#t", "sku": null}, "confidence": 0.7, "notes": "n"}',
        '  ```json\n{"extracted": {"price": "$5"}}\n```  ',
        "not json at all",
        "[1, 2]",
        '{"extracted": null}',
    ]
    df = spark.createDataFrame([(i, t, 10, i) for i, t in enumerate(texts)], "i int, raw_text string, input_tokens long, output_tokens long")
    a, b, c, d, e = responses.parse_responses(df).orderBy("i").collect()
    assert a.ok and a.extracted["title"] == "T" and a.extracted["n"] is None and a.price_number == -5.0 and a.in_stock_flag is True
    assert a.selectors == {"title": "#t", "sku": None} and a.confidence == 0.7 and a.notes == "n" and a.tokens == 10
    assert b.ok and b.extracted == {"price": "$5"} and b.selectors == {} and b.confidence == 0.5 and b.notes == ""
    assert b.price_number is None
    assert not c.ok and c.error.endswith("not json at all") and c.confidence is None and c.extracted == {}
    assert not d.ok
    assert e.ok and e.extracted == {}


ANSWERS = [
    ('{"extracted": {"price": "1"}, "selectors": {}} trailing', False, {}, None),
    ('{"extracted": {"price": "1"}}] x', False, {}, None),
    ('{"extracted": {"price": "1"}}} x', False, {}, None),
    ("[1]", False, {}, None),
    ('```json\n{"extracted": {"title": "a", "title": "b"}, "extracted": {"title": "c", "sku": true, "sku": 7}}\n```', True, {"title": "c", "sku": "7"}, None),
    ('{"extracted": {"review_count": 12.0, "title": true, "brand": "true", "price": 12.50}}', True, {"review_count": "12.0", "title": "True", "brand": "true", "price": "12.5"}, 12.5),
    ('{"extracted": 5, "confidence": "high"}', True, {}, None),
    (None, False, {}, None),
]


def test_answers(spark):
    from driftloom.functions.responses import parse_responses

    df = spark.createDataFrame([(i, t, 1, 2) for i, (t, *_) in enumerate(ANSWERS)], "i int, raw_text string, input_tokens long, output_tokens long")
    rows = parse_responses(df).orderBy("i").collect()
    for r, (_, ok, extracted, price) in zip(rows, ANSWERS):
        got = {k: v if k != "price" else v.rstrip("0") for k, v in r.extracted.items()}
        assert (r.ok, got, r.price_number) == (ok, extracted, price)
    # A count that came as 12.0 is read like its text.
    typed = parse_responses(df.filter("i = 5")).select(parsing.parse_review_count(F.col("extracted")["review_count"]))
    assert typed.first()[0] == 120
