"""Columns of a product: parsing raw metadata and writing product texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from aislekit import vocabulary as V
from aislekit.functions.draws import let, pick
from aislekit.functions.text import BLANK, number_text, strip

# What a price may look like. Not-a-number and infinity are left out, since one row would decide every range.
_NUMBER = r"^[\s]*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[\s]*$"


def target_category(main_category: Column) -> Column:
    """One of the five targets for a raw category name, else null.

    Only case is ignored: blanks and `&` are not turned into underscores.
    """
    name = F.lower(main_category)
    found = F.lit(None).cast("string")
    for target in reversed(V.TARGET_CATEGORIES):
        found = F.when(name.isin(V.RAW_CATEGORY_NAMES[target]), F.lit(target)).otherwise(found)
    return found


def sub_category(categories: Column) -> Column:
    """The most specific name of `[[…], …]` or `[…]` given as JSON text, else an empty text."""
    def last_text(values: Column) -> Column:
        return F.try_variant_get(F.try_element_at(values, F.lit(-1)), "$", "string")

    def last(outer: Column) -> Column:
        inner = F.try_variant_get(F.get(outer, F.lit(0)), "$", "array<variant>")
        return let(inner, lambda names: F.when(F.size(names) > 0, last_text(names)).otherwise(last_text(outer)))

    outer = F.try_variant_get(F.try_parse_json(categories), "$", "array<variant>")
    return let(outer, lambda names: F.when(F.size(names) > 0, last(names)).otherwise(F.lit("")))


def features_of(features: Column) -> Column:
    """The list in a JSON text; anything that is not a list gives an empty one."""
    return F.coalesce(F.from_json(features, "array<string>"), F.array().cast("array<string>"))


def price_of(price: Column) -> Column:
    """The price as a number; texts that are none, such as `None` or `$9`, give null."""
    return let(
        F.when(price.rlike(_NUMBER), F.trim(price).try_cast("double")), lambda p: F.when(F.abs(p) < float("inf"), p)
    )


def brand_of(details: Column) -> Column:
    """`Brand`, else `brand`, of a JSON object text, else an empty text."""
    return F.coalesce(
        F.get_json_object(details, "$.Brand"), F.get_json_object(details, "$.brand"), F.lit("")
    )


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def product_text(p: Column) -> Column:
    """The text of a product that is embedded for search."""
    def shown(value: Column, missing: str) -> Column:
        return F.coalesce(value, F.lit(missing))

    return F.concat(
        shown(p["title"], ""), F.lit(" "), shown(p["brand"], ""), F.lit(" "), shown(p["category"], ""),
        F.lit(" "), shown(p["sub_category"], ""), F.lit(" $"), shown(number_text(p["price"]), "None"), F.lit(" "),
        F.coalesce(F.array_join(p["features"], " "), F.lit("")),
    )


def feature_phrase(features: Column, default: str) -> Column:
    """`features A`, `features A and B`, `features A, B, and C`, or the default for none."""
    n = F.size(features)
    first = F.array_join(F.slice(features, 1, F.greatest(n - 1, F.lit(0))), ", ")
    last = F.get(features, n - 1)
    return (
        F.when(features.isNull() | (n == 0), F.lit(default))
        .when(n == 1, F.concat(F.lit("features "), last))
        .when(n == 2, F.concat(F.lit("features "), first, F.lit(" and "), last))
        .otherwise(F.concat(F.lit("features "), first, F.lit(", and "), last))
    )


def fixed(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, rounded from its exact binary value."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def product_line(p: Column, style: str) -> Column:
    """The sentence on a product in a `list` or a `reject` reply."""
    title = F.coalesce(p["title"], F.lit("Product"))
    brand = F.coalesce(p["brand"], F.lit("Brand"))
    price = fixed(F.coalesce(p["price"], F.lit(0.0)), 2)
    if style == "list":
        rating = fixed(F.coalesce(p["avg_rating"], F.lit(4.0)), 1)
        return F.concat(
            F.lit("the "), title, F.lit(" from "), brand, F.lit(" ($"), price, F.lit(", "), rating,
            F.lit(" stars) which "), feature_phrase(p["features"], "is a quality product"),
        )
    rating = fixed(F.coalesce(p["avg_rating"], F.lit(0.0)), 1)
    return F.concat(
        F.lit("- "), title, F.lit(" by "), brand, F.lit(" ($"), price, F.lit(", "), rating,
        F.lit(" stars), which "), feature_phrase(p["features"], "is a solid option"), F.lit("."),
    )


def item_phrase(products: Column, drawn: Column, fallback: str) -> Column:
    """What the shopper calls the item: the head of a random title without its brand."""
    titles = F.filter(F.transform(products, lambda p: p["title"]), lambda t: F.length(t) > 0)
    brands = F.filter(F.transform(products, lambda p: p["brand"]), lambda b: F.length(b) > 0)

    def shorten(title: Column) -> Column:
        core = strip(F.substring_index(title, " - ", 1))
        words = F.split(core, f"{BLANK}+")
        known = (F.size(words) > 1) & F.array_contains(brands, F.get(words, F.lit(0)))
        rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
        return F.lower(F.when(known, rest).otherwise(core))

    return F.coalesce(let(pick(titles, drawn), shorten), F.lit(fallback))
