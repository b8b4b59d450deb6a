"""Policy answers and the final reply to a shopper question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from aislekit import vocabulary as V
from aislekit.functions import routing as R
from aislekit.functions.replies import clean_reply, strip_tool_tags
from aislekit.functions.text import asks
from aislekit.sources.policy import load_policy


def bounded(policy: DataFrame) -> DataFrame:
    """The policy rows a question can ask for: one per category, five categories, so five rows."""
    last = load_policy(policy.where(F.col("category").isin(V.TARGET_CATEGORIES)))
    return last.withColumn("line_no", F.lit(1).cast("bigint"))


def with_policy_texts(
    df: DataFrame, shipping: DataFrame, returns: DataFrame, query: str = "user_query"
) -> DataFrame:
    """The questions with their category and the two policy texts."""
    def texts(policy: DataFrame, text: Callable, name: str) -> DataFrame:
        rows = bounded(policy)
        return rows.select("category", text({c: F.col(c) for c in rows.columns}).alias(name))

    ship_texts = F.broadcast(texts(shipping, R.shipping_text, "shipping_text"))
    back_texts = F.broadcast(texts(returns, R.returns_text, "returns_text"))
    category = F.col("category")
    return (
        df.withColumn("category", R.query_category(F.col(query)))
        .join(ship_texts, "category", "left")
        .join(back_texts, "category", "left")
        .withColumns({
            "shipping_text": F.coalesce("shipping_text", R.no_shipping_text(category)),
            "returns_text": F.coalesce("returns_text", R.no_returns_text(category)),
        })
    )


def policy_lookup(
    df: DataFrame, shipping: DataFrame, returns: DataFrame, query: str = "user_query"
) -> DataFrame:
    """The questions with route, category and the policy text; null text means a product search."""
    told = with_policy_texts(df, shipping, returns, query).withColumn("route", R.route_query(F.col(query)))
    return told.withColumn(
        "policy_text",
        F.when(F.col("route") == "shipping", F.col("shipping_text"))
        .when(F.col("route") == "returns", F.col("returns_text")),
    ).drop("shipping_text", "returns_text")


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def resolve_reply(
    df: DataFrame, shipping: DataFrame, returns: DataFrame, strict: bool = False
) -> DataFrame:
    """The recorded replies with the `agent_reply` a shopper would get.

    Needs user_query, raw_reply and followup_reply (the reply after a policy call).
    `strict` is the batch form: a reply that calls nothing is only cleaned, and may be empty.
    """
    told = with_policy_texts(df, shipping, returns)
    query, raw = F.col("user_query"), F.col("raw_reply")
    told = told.withColumns({
        "called": R.tool_called(raw, query),
        "first": clean_reply(raw),
        "follow": strip_tool_tags(clean_reply(F.col("followup_reply"))),
    })
    first = F.col("first")
    if strict:
        plain = first
    else:
        kept = strip_tool_tags(first)
        plain = (
            F.when((first == "") & asks(query, V.SHORT_SHIPPING_WORDS), F.col("shipping_text"))
            .when((first == "") & asks(query, V.SHORT_RETURN_WORDS), F.col("returns_text"))
            .otherwise(F.coalesce(_filled(kept), F.lit(V.NO_INFORMATION)))
        )
    reply = (
        F.when(F.col("called") == "shipping", F.coalesce(_filled(F.col("follow")), F.col("shipping_text")))
        .when(F.col("called") == "returns", F.coalesce(_filled(F.col("follow")), F.col("returns_text")))
        .otherwise(plain)
    )
    return told.withColumn("agent_reply", reply).select(*df.columns, "agent_reply")


def followup_prompt(prompt: Column, raw_reply: Column, tool_text: Column) -> Column:
    """What the model is asked after its first reply called for a policy: the prompt, that reply, the policy text."""
    return F.concat(prompt, raw_reply, F.lit(f"\n\n{V.TOOL_RESULT}"), tool_text, F.lit(f"\n\n{V.TOOL_INSTRUCTION}"))


def followup_prompts(df: DataFrame, shipping: DataFrame, returns: DataFrame) -> DataFrame:
    """The replies with `called`, the policy they call for, and the `followup_prompt` of those that call for one.

    Needs prompt, user_query and raw_reply.
    """
    told = with_policy_texts(df, shipping, returns).withColumn("called", R.tool_called(F.col("raw_reply"), F.col("user_query")))
    text = F.when(F.col("called") == "shipping", F.col("shipping_text")).when(F.col("called") == "returns", F.col("returns_text"))
    followup = followup_prompt(F.col("prompt"), F.col("raw_reply"), text)
    return told.withColumn("followup_prompt", followup).select(*df.columns, "called", "followup_prompt")


def edge_case_replies(df: DataFrame, shipping: DataFrame, returns: DataFrame) -> DataFrame:
    """Edge cases with their reply, or `ERROR: …` for a failed run."""
    replied = resolve_reply(df, shipping, returns, strict=True)
    return replied.select(
        *[c for c in df.columns if c not in ("raw_reply", "followup_reply", "error")],
        F.when(F.col("error").isNotNull(), F.concat(F.lit("ERROR: "), F.col("error")))
        .otherwise(F.col("agent_reply")).alias("agent_reply"),
    )
