"""Ingest of extractor responses: JSON text, sometimes fenced, sometimes broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.parsing import strip

ERROR_CHARS = 500


def unfence(text: Column) -> Column:
    """Strip white space, one leading code fence and one trailing code fence."""
    opened = F.regexp_replace(strip(text), r"^```(?:json)?\s*", "")
    bare = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))  # most: no pattern is run
    return F.when(bare, text).otherwise(F.regexp_replace(opened, r"\s*```\z", ""))


_TEXTS = "struct<extracted:map<string,string>,selectors:map<string,string>,confidence:double,notes:string>"
_KINDS = "struct<extracted:map<string,variant>>"


def is_one_object(body: Column) -> Column:
    """The text is one JSON object and nothing else.

    JSON readers stop where the first value ends. Put between brackets, and as a field of an
    object, the text only reads as one value if nothing follows it.
    """
    alone = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    inner = F.size(F.json_object_keys(F.concat(F.lit('{"d":'), body, F.lit("}")))) == 1
    return F.coalesce(F.startswith(body, F.lit("{")) & alone & inner, F.lit(False))


def _last_of_each(entries: Column) -> Column:
    """Map of entries, by key; repeated keys keep their last value."""
    rest = F.transform(entries, lambda e, i: F.struct(e.alias("e"), F.slice(entries, i + 2, F.size(entries)).alias("later")))
    kept = F.filter(rest, lambda r: ~F.exists(r["later"], lambda e: e["key"] == r["e"]["key"]))
    return F.map_from_entries(F.array_sort(F.transform(kept, lambda r: r["e"])))


def _by_key(texts: Column) -> Column:
    """The map in order of its keys, which are different."""
    return F.map_from_entries(F.array_sort(F.map_entries(texts)))


def _shown(texts: Column, kinds: Column) -> Column:
    """Entries of texts, in order; booleans read ``True`` and ``False``."""

    def shown(text: Column, typed: Column) -> Column:
        value = F.when(F.schema_of_variant(typed["value"]) == "BOOLEAN", F.initcap(text["value"])).otherwise(text["value"])
        return F.struct(text["key"].alias("key"), value.alias("value"))

    return F.zip_with(texts, kinds, shown)


def parse_responses(df: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Add ``ok``, ``extracted``, ``selectors``, ``confidence``, ``notes``, ``tokens``, ``error``.

    Of repeated keys the last counts. Numbers keep their source text, booleans read ``True`` and
    ``False``. ``price_number`` and ``in_stock_flag`` keep values that came as JSON numbers and
    booleans, because those pass through the field parsers untouched.

    One VARIANT decides what a response is: the body is parsed inside brackets that only read
    back whole if it is one value, for they end in a hash of the body. Repeated keys make no
    VARIANT; such bodies, and broken ones, take a slower way, branch by branch.
    """
    staged = df.withColumn("_body", unfence(F.col(raw)))
    body, mark = F.col("_body"), F.md5("_body")
    wrapped = F.concat(F.lit('{"d":['), body, F.lit('],"end":"'), mark, F.lit('"}'))
    staged = staged.withColumn("_doc", F.try_parse_json(wrapped))
    doc = F.col("_doc")
    whole = (F.try_variant_get(doc, "$.end", "string") == mark) & F.try_variant_get(doc, "$.d[1]", "variant").isNull()
    whole = F.coalesce(whole & F.startswith(body, F.lit("{")), F.lit(False))
    # Two steps, or Spark would put each expression in every place that reads it.
    staged = staged.withColumn("ok", F.when(doc.isNotNull(), whole).otherwise(is_one_object(body)))
    staged = staged.withColumn("_texts", F.from_json(F.when(F.col("ok"), body), _TEXTS))
    ok, plain = F.col("ok"), doc.isNotNull()
    texts, selectors = F.col("_texts.extracted"), F.col("_texts.selectors")
    empty = F.create_map().cast("map<string,string>")

    # Repeated keys, or a text that may be a boolean: kinds by a reading of their own.
    kinds = F.map_entries(F.from_json(F.when(ok, body), _KINDS)["extracted"])
    careful = _last_of_each(_shown(F.map_entries(texts), kinds))
    doubtful = F.exists(F.map_values(texts), lambda v: v.isin("true", "false"))
    extracted = F.when(~ok, empty).when(plain & ~doubtful, _by_key(texts)).otherwise(careful)

    def typed(field: str) -> Column:
        slow = F.element_at(F.filter(kinds, lambda e: e["key"] == field), -1)["value"]
        has = F.exists(kinds, lambda e: e["key"] == field)
        return F.when(ok & plain, F.try_variant_get(doc, f"$.d[0].extracted.{field}", "variant")).when(ok & has, slow)

    staged = staged.withColumns({"_price": typed("price"), "_stock": typed("in_stock")})
    price, stock = F.col("_price"), F.col("_stock")
    price_kind = F.schema_of_variant(price)
    columns = {
        "extracted": F.coalesce(extracted, empty),
        "selectors": F.coalesce(F.when(plain, _by_key(selectors)).otherwise(_last_of_each(F.map_entries(selectors))), empty),
        "confidence": F.when(ok, F.coalesce("_texts.confidence", F.lit(0.5))),
        "notes": F.when(ok, F.coalesce("_texts.notes", F.lit(""))),
        "price_number": F.when(
            price_kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(price_kind, F.lit("DECIMAL")),
            F.try_variant_get(price, "$", "double"),
        ),
        "in_stock_flag": F.when(F.schema_of_variant(stock) == "BOOLEAN", F.try_variant_get(stock, "$", "boolean")),
        "tokens": F.col("input_tokens") + F.col("output_tokens"),
        "error": F.when(
            ~ok, F.concat(F.lit("invalid JSON response: "), F.left(body, F.lit(ERROR_CHARS)))
        ),
    }
    return staged.withColumns(columns).drop("_body", "_doc", "_texts", "_price", "_stock")
