"""Typed product fields from raw text. No parser raises: what cannot be read is NULL.

Digits are ASCII digits throughout (documented choice).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text caps in code points.
TEXT_CAPS = {"title": 500, "brand": 200, "sku": 100, "description": 1000}

# Currency signs and their codes.
CURRENCY_CODES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}

# Stock phrases. The negative ones are checked first.
OUT_OF_STOCK = ("out of stock", "unavailable", "sold out")
IN_STOCK = ("in stock", "available", "add to cart", "buy now")


# The characters that count as white space at the ends of a text.
_SPACE_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
                 (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
                 (0x3000, 0x3000))
WHITE_SPACE = "".join(chr(c) for low, high in _SPACE_RANGES for c in range(low, high + 1))


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks; looks at the ends only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def parse_text(raw: Column, limit: int) -> Column:
    """Stripped and cut to ``limit`` code points; the empty string stays and counts as present."""
    return F.left(strip(raw), F.lit(limit))


def parse_price(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9.]", "").try_cast("double")


def parse_currency(raw: Column) -> Column:
    text = strip(raw)
    code = F.lit(None).cast("string")
    for sign, name in CURRENCY_CODES.items():
        code = F.when(text == sign, F.lit(name)).otherwise(code)
    return F.when(text != "", F.coalesce(code, F.left(F.upper(text), F.lit(3))))


def parse_rating(raw: Column) -> Column:
    number = F.regexp_extract(raw, r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
    return F.when((number >= 0.0) & (number <= 5.0), number)


def parse_review_count(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "").try_cast("bigint")


def parse_in_stock(raw: Column) -> Column:
    text = F.lower(raw)

    def mentions(phrases: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for phrase in phrases:
            found = found | F.contains(text, F.lit(phrase))
        return found

    return F.when(mentions(OUT_OF_STOCK), F.lit(False)).when(mentions(IN_STOCK), F.lit(True))


def parse_product(raw) -> dict[str, Column]:
    """All nine typed fields; ``raw`` maps a field name to its raw text column."""
    return {
        "title": parse_text(raw("title"), TEXT_CAPS["title"]),
        "price": parse_price(raw("price")),
        "currency": parse_currency(raw("currency")),
        "in_stock": parse_in_stock(raw("in_stock")),
        "rating": parse_rating(raw("rating")),
        "review_count": parse_review_count(raw("review_count")),
        "sku": parse_text(raw("sku"), TEXT_CAPS["sku"]),
        "brand": parse_text(raw("brand"), TEXT_CAPS["brand"]),
        "description": parse_text(raw("description"), TEXT_CAPS["description"]),
    }
