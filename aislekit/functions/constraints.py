"""The constraint test that decides every task answer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from aislekit.functions.draws import let


def constraint(max_price: Column, brand: Column, features: Column, min_rating: Column) -> Column:
    """A constraint as a struct; a null part asks for nothing."""
    return F.struct(
        max_price.cast("double").alias("max_price"), brand.cast("string").alias("brand"),
        features.cast("array<string>").alias("features"), min_rating.cast("double").alias("min_rating"),
    )


def matches(product: Column, cons: Column) -> Column:
    """Whether the product meets the constraint.

    An unknown price or rating passes, an unknown brand does not. Never null.
    """
    none = F.array().cast("array<string>")
    price_ok = cons["max_price"].isNull() | product["price"].isNull() | (product["price"] <= cons["max_price"])
    brand_ok = (
        cons["brand"].isNull() | (cons["brand"] == "") | product["brand"].eqNullSafe(cons["brand"])
    )
    rating_ok = (
        cons["min_rating"].isNull() | product["avg_rating"].isNull()
        | (product["avg_rating"] >= cons["min_rating"])
    )
    # Last, since it is the dearest test: most products fail before it.
    has_all = F.forall(
        F.coalesce(cons["features"], none),
        lambda f: F.coalesce(F.array_contains(product["features"], f), F.lit(False)),
    )
    return price_ok & brand_ok & rating_ok & has_all


def satisfying(products: Column, cons: Column) -> Column:
    """The products of an array that meet the constraint, in order. The constraint is computed once, not for each product."""
    return let(cons, lambda c: F.filter(products, lambda p: matches(p, c)))


def ids(products: Column) -> Column:
    return F.transform(products, lambda p: p["product_id"])
