"""Rule scores of replies, all as Columns.

Every `eval_*` gives a struct of four flags with the texts found for and against the reply.
`failure` tells why scoring itself breaks: an expected value it needs is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from aislekit import vocabulary as V
from aislekit.functions.draws import let
from aislekit.functions.text import asks, has_any, is_blank, minimal, number_text

_NO_TEXTS = "array<string>"

# The error texts of a comparison with a missing value.
_NO_NUMBER = "'>' not supported between instances of 'NoneType' and 'int'"
_NO_LIST = "'NoneType' object is not iterable"
_NO_TITLE = "'NoneType' object has no attribute 'lower'"

# What is reported against and for a reply.
_NUMBER_WRONG = "{} information present but inaccurate"
_NUMBER_UNKNOWN = "{} information present but no expected {} to compare"
_NOTHING_FOUND = "No {} information found"
_NUMBER_RIGHT = "Accurate {} information"
_BRAND_WRONG = "Brand information present but inaccurate"
_BRAND_UNKNOWN = "Brand information present but no expected brand to compare"
_BRAND_NONE = "No brand information found"
_BRAND_RIGHT = "Accurate brand information"
_FEATURES_WRONG = "Feature information present but doesn't match expected features"
_FEATURES_UNKNOWN = "Feature information present but no expected features to compare"
_FEATURES_NONE = "No feature information found"
_FEATURES_RIGHT = "Found features: "
_CHECK_UNCLEAR = "Response doesn't clearly answer yes/no"
_CHECK_UNKNOWN = "Could not identify specific feature being asked about"
_CHECK_DENIED = "Incorrectly denied"
_CHECK_CLAIMED = "Incorrectly claimed"
_CHECK_PRESENT = "Correctly identified"
_CHECK_ABSENT = "Correctly identified absence of"
_TOPIC_FOUND = "Contains {} information"
_TOO_SHORT = "Response too short"
_NO_PRODUCT = "Response doesn't mention the product"
_LONG_ENOUGH = "Response has adequate length"
_PRODUCT_NAMED = "Response mentions the product"
_EMPTY_REPLY = "Empty response"
_ERROR_REPLY = "Contains error"


def contains_error_wide(text: Column) -> Column:
    return asks(text, V.ERROR_PHRASES_WIDE)


def contains_error_narrow(text: Column) -> Column:
    return asks(text, V.ERROR_PHRASES_NARROW)


def query_intent(query: Column) -> Column:
    """The intent that picks the scoring rule."""
    q = F.lower(query)
    opening = reduce(lambda a, b: a | b, [q.startswith(o) for o in V.CHECK_OPENINGS])
    return (
        F.when(has_any(q, V.PRICE_INTENT), "price_inquiry")
        .when(has_any(q, V.RATING_INTENT), "rating_inquiry")
        .when(has_any(q, V.BRAND_INTENT), "brand_inquiry")
        .when(q.contains("features"), "feature_inquiry")
        .when(opening, "feature_check")
        .when(has_any(q, minimal(V.SHIPPING_INTENT)), "shipping_inquiry")
        .when(has_any(q, V.RETURN_INTENT), "return_inquiry")
        .otherwise("general_inquiry")
    )


def query_type(query: Column) -> Column:
    """The type a query is reported under; its words differ from the intent's."""
    q = F.lower(query)
    return (
        F.when(has_any(q, V.PRICE_TYPE), "price")
        .when(has_any(q, V.RATING_TYPE), "rating")
        .when(has_any(q, V.BRAND_TYPE), "brand")
        .when(q.contains("features"), "features")
        .when(has_any(q, minimal(V.SHIPPING_TYPE)), "shipping")
        .when(has_any(q, V.RETURN_TYPE), "return_policy")
        .when(has_any(q, V.CHECK_TYPE), "feature_check")
        .otherwise("general")
    )


def confidence(helpful: Column, accurate: Column, complete: Column, relevant: Column) -> Column:
    def worth(flag: Column, points: float) -> Column:
        return F.when(flag, F.lit(points)).otherwise(F.lit(0.0))

    return worth(helpful, 0.3) + worth(accurate, 0.3) + worth(complete, 0.2) + worth(relevant, 0.2)


def _texts(*options: Column) -> Column:
    """The non-null texts as a list."""
    return F.filter(F.array(*options), lambda t: t.isNotNull()).cast(_NO_TEXTS)


def _said(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text))


def _finding(
    helpful: Column, accurate: Column, complete: Column, relevant: Column,
    issues: Column, strengths: Column, failure: Column | None = None,
) -> Column:
    return F.struct(
        helpful.alias("is_helpful"), accurate.alias("is_accurate"), complete.alias("is_complete"),
        relevant.alias("is_relevant"), confidence(helpful, accurate, complete, relevant).alias("confidence_score"),
        issues.alias("issues"), strengths.alias("strengths"),
        (F.lit(None) if failure is None else failure).cast("string").alias("failure"),
    )


def _shown(patterns: list[str], reply: Column) -> Column:
    return reply.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


def _eval_number(reply: Column, expected: Column, patterns: list[str], name: str, words: list[str]) -> Column:
    """The common rule for price and rating."""
    def score(f: Column) -> Column:
        found, known = f["found"], F.coalesce(f["expected"] > 0, F.lit(False))
        accurate = found & known & F.coalesce(reply.contains(number_text(f["expected"])), F.lit(False))
        title = name.capitalize()
        return _finding(
            found & (accurate | F.coalesce(f["expected"] == 0, F.lit(False))),
            accurate,
            found & (F.length(reply) > 20),
            has_any(F.lower(reply), words),
            _texts(
                _said(found & known & ~accurate, _NUMBER_WRONG.format(title)),
                _said(found & ~known, _NUMBER_UNKNOWN.format(title, name)),
                _said(~found, _NOTHING_FOUND.format(name)),
            ),
            _texts(_said(accurate, _NUMBER_RIGHT.format(name))),
            _said(found & f["expected"].isNull(), _NO_NUMBER),
        )

    return let(F.struct(_shown(patterns, reply).alias("found"), expected.alias("expected")), score)


def eval_price(reply: Column, price: Column) -> Column:
    return _eval_number(reply, price, V.PRICE_PATTERNS, "price", ["price", "$"])


def eval_rating(reply: Column, avg_rating: Column) -> Column:
    return _eval_number(reply, avg_rating, V.RATING_PATTERNS, "rating", ["rating", "star"])


def eval_brand(reply: Column, brand: Column) -> Column:
    def score(f: Column) -> Column:
        found, known = f["found"], F.coalesce(brand != "", F.lit(False))
        accurate = found & known & F.coalesce(F.lower(reply).contains(F.lower(brand)), F.lit(False))
        return _finding(
            found & (accurate | ~known),
            accurate,
            found & (F.length(reply) > 20),
            F.lower(reply).contains("brand"),
            _texts(
                _said(found & known & ~accurate, _BRAND_WRONG),
                _said(found & ~known, _BRAND_UNKNOWN),
                _said(~found, _BRAND_NONE),
            ),
            _texts(_said(accurate, _BRAND_RIGHT)),
        )

    return let(F.struct(_shown(V.BRAND_PATTERNS, reply).alias("found")), score)


def eval_features(reply: Column, features: Column) -> Column:
    low = F.lower(reply)

    def score(f: Column) -> Column:
        found, known, named = f["found"], F.coalesce(F.size(features) > 0, F.lit(False)), f["named"]
        accurate = found & known & F.coalesce(F.size(named) > 0, F.lit(False))
        return _finding(
            found & (accurate | ~known),
            accurate,
            found & (F.length(reply) > 30),
            found,
            _texts(
                _said(found & known & ~accurate, _FEATURES_WRONG),
                _said(found & ~known, _FEATURES_UNKNOWN),
                _said(~found, _FEATURES_NONE),
            ),
            _texts(F.when(accurate, F.concat(F.lit(_FEATURES_RIGHT), F.array_join(named, ", ")))),
        )

    named = F.filter(features, lambda f: low.contains(F.lower(f)))
    return let(F.struct(low.contains("feature").alias("found"), named.alias("named")), score)


def eval_feature_check(query: Column, reply: Column, features: Column) -> Column:
    q, low = F.lower(query), F.lower(reply)
    asked = F.lit(None).cast("string")
    for feature in reversed(V.CHECKED_FEATURES):
        asked = F.when(q.contains(feature), F.lit(feature)).otherwise(asked)

    def score(f: Column) -> Column:
        asked, yes, no = f["asked"], f["yes"], f["no"]
        known = asked.isNotNull()
        answered = known & (yes | no)
        has = F.coalesce(F.array_contains(F.transform(features, F.lower), asked), F.lit(False))
        accurate = answered & ((has & yes) | (~has & no))

        def about(condition: Column, head: str) -> Column:
            return F.when(condition, F.concat(F.lit(head + " "), asked, F.lit(" feature")))

        return _finding(
            answered,
            accurate,
            answered & (F.length(reply) > 20),
            F.coalesce(low.contains(asked), F.lit(False)),
            _texts(
                about(answered & has & ~yes, _CHECK_DENIED),
                about(answered & ~has & ~no, _CHECK_CLAIMED),
                _said(known & ~(yes | no), _CHECK_UNCLEAR),
                _said(~known, _CHECK_UNKNOWN),
            ),
            _texts(
                about(answered & has & yes, _CHECK_PRESENT),
                about(answered & ~has & no, _CHECK_ABSENT),
            ),
            _said(answered & features.isNull(), _NO_LIST),
        )

    facts = F.struct(
        asked.alias("asked"), has_any(low, V.YES_WORDS).alias("yes"), has_any(low, minimal(V.NO_WORDS)).alias("no")
    )
    return let(facts, score)


def _eval_topic(reply: Column, words: list[str], relevant: list[str], name: str) -> Column:
    low = F.lower(reply)

    def score(f: Column) -> Column:
        found = f["found"]
        return _finding(
            found,
            F.lit(True),
            found & (F.length(reply) > 30),
            has_any(low, relevant),
            _texts(_said(~found, _NOTHING_FOUND.format(name))),
            _texts(_said(found, _TOPIC_FOUND.format(name))),
        )

    return let(F.struct(has_any(low, words).alias("found")), score)


def eval_shipping(reply: Column) -> Column:
    """Counted as accurate throughout: the text comes from the policy table."""
    return _eval_topic(reply, V.SHIPPING_REPLY_WORDS, ["shipping", "delivery"], "shipping")


def eval_returns(reply: Column) -> Column:
    return _eval_topic(reply, V.RETURN_REPLY_WORDS, ["return", "policy"], "return policy")


def eval_general(reply: Column, title: Column) -> Column:
    low, n = F.lower(reply), F.length(reply)

    def score(f: Column) -> Column:
        named = f["named"]
        return _finding(
            n > 10,
            F.lit(True),
            n > 30,
            named,
            _texts(_said(n < 10, _TOO_SHORT), _said(~named, _NO_PRODUCT)),
            _texts(
                _said(n >= 10, _LONG_ENOUGH), _said(named, _PRODUCT_NAMED)
            ),
            _said(title.isNull() & ~low.contains("product"), _NO_TITLE),
        )

    named = low.contains("product") | F.coalesce(low.contains(F.lower(title)), F.lit(False))
    return let(F.struct(named.alias("named")), score)


def _rejected(issue: str) -> Column:
    no = F.lit(False)
    return _finding(no, no, no, no, _texts(F.lit(issue)), _texts(F.lit(None).cast("string")))


def evaluate_reply(
    query: Column, reply: Column, *, title: Column, price: Column, brand: Column,
    features: Column, avg_rating: Column,
) -> Column:
    """The finding on one reply: empty and failed replies first, then the rule of the intent."""
    def by_intent(intent: Column) -> Column:
        return (
            F.when(intent == "price_inquiry", eval_price(reply, price))
            .when(intent == "rating_inquiry", eval_rating(reply, avg_rating))
            .when(intent == "brand_inquiry", eval_brand(reply, brand))
            .when(intent == "feature_inquiry", eval_features(reply, features))
            .when(intent == "feature_check", eval_feature_check(query, reply, features))
            .when(intent == "shipping_inquiry", eval_shipping(reply))
            .when(intent == "return_inquiry", eval_returns(reply))
            .otherwise(eval_general(reply, title))
        )

    return (
        F.when(is_blank(reply), _rejected(_EMPTY_REPLY))
        .when(contains_error_wide(reply), _rejected(_ERROR_REPLY))
        .otherwise(let(query_intent(query), by_intent))
    )
