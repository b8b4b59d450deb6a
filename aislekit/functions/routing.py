"""Topic, category and policy texts for shopper questions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from aislekit import vocabulary as V
from aislekit.functions.text import asks


def asks_shipping(query: Column) -> Column:
    return asks(query, V.SHIPPING_WORDS)


def asks_returns(query: Column) -> Column:
    return asks(query, V.RETURN_WORDS)


def route_query(query: Column) -> Column:
    """`shipping`, `returns` or `search`; shipping wins when both are asked."""
    return (
        F.when(asks_shipping(query), F.lit("shipping"))
        .when(asks_returns(query), F.lit("returns"))
        .otherwise(F.lit("search"))
    )


def query_category(query: Column) -> Column:
    """The category whose word list matches first."""
    found = F.lit(V.DEFAULT_QUERY_CATEGORY)
    for category, words in reversed(V.QUERY_CATEGORY_WORDS.items()):
        found = F.when(asks(query, words), F.lit(category)).otherwise(found)
    return found


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def shipping_text(p: Column) -> Column:
    """The shipping options of one policy row; standard is always free."""
    return F.concat(
        F.lit("Shipping options:\n- Standard: "), _shown(p["standard_days"]), F.lit(" days (free)\n- Express: "),
        _shown(p["express_days"]), F.lit(" days ($"), _shown(p["express_cost"]), F.lit(")\n- Overnight: "),
        _shown(p["overnight_days"]), F.lit(" days ($"), _shown(p["overnight_cost"]), F.lit(")"),
    )


def returns_text(p: Column) -> Column:
    """The return policy of one policy row."""
    return F.concat(
        F.lit("Return policy:\n- Return window: "), _shown(p["return_window"]), F.lit("\n- Condition: "),
        _shown(p["condition"]), F.lit("\n- Restocking fee: $"), _shown(p["restocking_fee"]),
        F.lit("\n- Special notes: "), _shown(p["special_notes"]),
    )


def no_shipping_text(category: Column) -> Column:
    return F.concat(F.lit("Shipping information not available for "), category, F.lit("."))


def no_returns_text(category: Column) -> Column:
    return F.concat(F.lit("Return policy not available for "), category, F.lit("."))


def _tagged(raw: Column, tags: list[str]) -> Column:
    found = F.lit(False)
    for tag in tags:
        found = found | F.coalesce(raw, F.lit("")).contains(tag)
    return found


def tool_called(raw: Column, query: Column) -> Column:
    """The policy a recorded reply calls for, if the shopper asked about that topic, else null."""
    return (
        F.when(_tagged(raw, V.SHIPPING_TAGS) & asks_shipping(query), F.lit("shipping"))
        .when(_tagged(raw, V.RETURN_TAGS) & asks_returns(query), F.lit("returns"))
    )
