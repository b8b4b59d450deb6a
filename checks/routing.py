"""Routing, policy answers, clean-up and replies, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit import vocabulary as V
from aislekit.functions import replies as X, routing as R
from aislekit.operators import replies as O
from aislekit.operators.chat import prompt_of
from aislekit.session import fresh_path
from aislekit.streaming import router
from checks import base as B
from checks.base import check, text, using, using_all


def any_of(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def route_sql(query: str) -> str:
    low = f"lower(coalesce({query}, ''))"
    return (
        f"CASE WHEN {any_of(low, V.SHIPPING_WORDS)} THEN 'shipping' "
        f"WHEN {any_of(low, V.RETURN_WORDS)} THEN 'returns' ELSE 'search' END"
    )


def category_sql(query: str) -> str:
    low = f"lower(coalesce({query}, ''))"
    arms = " ".join(f"WHEN {any_of(low, words)} THEN '{c}'" for c, words in V.QUERY_CATEGORY_WORDS.items())
    return f"CASE {arms} ELSE '{V.DEFAULT_QUERY_CATEGORY}' END"


def _last(name: str) -> tuple[str, str]:
    return (f"last_{name}", f"""SELECT * FROM {name} WHERE length(category) > 0
      QUALIFY row_number() OVER (PARTITION BY category ORDER BY line_no DESC) = 1""")


_LAST = (_last("shipping"), _last("returns"))
_SHIPPING_TEXT = """CASE WHEN s.category IS NULL THEN concat('Shipping information not available for ', q.category, '.')
  ELSE concat('Shipping options:', chr(10), '- Standard: ', coalesce(s.standard_days, 'None'), ' days (free)', chr(10),
    '- Express: ', coalesce(s.express_days, 'None'), ' days ($', coalesce(s.express_cost, 'None'), ')', chr(10),
    '- Overnight: ', coalesce(s.overnight_days, 'None'), ' days ($', coalesce(s.overnight_cost, 'None'), ')') END"""
_RETURNS_TEXT = """CASE WHEN r.category IS NULL THEN concat('Return policy not available for ', q.category, '.')
  ELSE concat('Return policy:', chr(10), '- Return window: ', coalesce(r.return_window, 'None'), chr(10),
    '- Condition: ', coalesce(r.condition, 'None'), chr(10), '- Restocking fee: $', coalesce(r.restocking_fee, 'None'),
    chr(10), '- Special notes: ', coalesce(r.special_notes, 'None')) END"""


@check("routed_queries", using("shopper", f"""
SELECT query_id, {route_sql('user_query')} AS route, {category_sql('user_query')} AS category FROM shopper"""))
def routed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = F.col("user_query")
    return B.shopper_queries(spark, sf_dir).select(
        "query_id", R.route_query(query).alias("route"), R.query_category(query).alias("category")
    )


_POLICY_SQL = using_all(["shopper", "shipping", "returns"], f"""
SELECT query_id, user_query, route, q.category,
  CASE route WHEN 'shipping' THEN {_SHIPPING_TEXT} WHEN 'returns' THEN {_RETURNS_TEXT} END AS policy_text
FROM (SELECT *, {route_sql('user_query')} AS route, {category_sql('user_query')} AS category FROM shopper) q
LEFT JOIN last_shipping s ON s.category = q.category LEFT JOIN last_returns r ON r.category = q.category""", *_LAST)


@check("policy_answers", _POLICY_SQL)
def policy_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipping, returns = B.policies(spark, sf_dir)
    return O.policy_lookup(B.shopper_queries(spark, sf_dir), shipping, returns)


@check("policy_texts", using_all(["shipping", "returns"], f"""
SELECT q.category, {_SHIPPING_TEXT} AS shipping_text, {_RETURNS_TEXT} AS returns_text
FROM (SELECT category FROM last_shipping UNION SELECT category FROM last_returns) q
LEFT JOIN last_shipping s ON s.category = q.category LEFT JOIN last_returns r ON r.category = q.category""", *_LAST))
def policy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per category, so each policy row is written out."""
    shipping, returns = B.policies(spark, sf_dir)
    words = F.create_map(*[F.lit(v) for c, ws in V.QUERY_CATEGORY_WORDS.items() for v in (c, ws[0])])
    asked = shipping.unionByName(returns, allowMissingColumns=True).where("length(category) > 0").select("category").distinct()
    asked = asked.select(F.when(F.col("category") == "Grocery_and_Gourmet_Food", "grocery").otherwise(words[F.col("category")]).alias("user_query"))
    return O.with_policy_texts(asked, shipping, returns).select("category", "shipping_text", "returns_text")


@check("routed_stream", _POLICY_SQL)
def routed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions read as a file stream, routed, and appended to a table."""
    shipping, returns = B.policies(spark, sf_dir)
    schema = B.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    routed = router.route_stream(B._run(spark, B.SHOPPER_SQL, events=events), shipping, returns)
    path = fresh_path(spark, "routed")
    router.write_stream(routed, path, path + "-offsets").awaitTermination()
    return spark.read.parquet(path)


# ---- clean-up ---------------------------------------------------------------------------

# Unicode blanks, spelled out because this dialect's \s is ASCII only.
_WS = r"[\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _sub(column: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({column}, {text(pattern)}, '{by}', 'g')"


def strip_sql(column: str) -> str:
    return _sub(_sub(column, rf"^{_WS}+"), rf"{_WS}+$")


def clean_sql(column: str) -> str:
    t = strip_sql(f"coalesce({column}, '')")
    for mark in [r"\|stop\|", r"\| Stop \|", r"\| Finish \|", "STOP", "END", "Finish", "Stop"]:
        t = _sub(t, rf"{_WS}*{mark}$")
    for pattern in (r"\|end[^|\n]*\|", r"<\|[^>]*\|>", r"(?i)\bSTOP\.?\b"):
        t = _sub(t, pattern)
    t = f"replace({t}, '|', ' ')"
    fillers = "|".join(V.FILLER_OPENINGS)
    for pattern in (
        rf"(?s)Available products:{_WS}*\[.*?\]{_WS}*", rf"(?i)(?:{fillers})[^.?!]*[.?!]?",
        r"(?i)I see you provided[^.]*\.?", r"(?i)I will provide[^.]*\.?",
        r"(?i)Please note that shipping times may vary[^.]*\.?", r"(?i)\bfinished\.?\b",
        rf"(?i)\b(?:What|How|Why|Where|When|Which){_WS}*$",
    ):
        t = _sub(t, pattern)
    return strip_sql(_sub(t, rf"{_WS}+", " "))


def untag_sql(column: str) -> str:
    return strip_sql(_sub(column, r"\[TOOL:[^\]]*\]"))


@check("clean_replies", using("raw_replies", f"""
SELECT query_id, {clean_sql('raw_reply')} AS cleaned, {untag_sql('raw_reply')} AS untagged FROM raw_replies"""))
def clean_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw_reply")
    return B.raw_replies(spark, sf_dir).select(
        "query_id", X.clean_reply(raw).alias("cleaned"), X.strip_tool_tags(raw).alias("untagged")
    )


_LOW = "lower(coalesce(user_query, ''))"
_CALLED = f"""CASE WHEN {any_of("coalesce(raw_reply, '')", V.SHIPPING_TAGS)} AND {any_of(_LOW, V.SHIPPING_WORDS)} THEN 'shipping'
  WHEN {any_of("coalesce(raw_reply, '')", V.RETURN_TAGS)} AND {any_of(_LOW, V.RETURN_WORDS)} THEN 'returns' END"""


@check("tool_calls", using("raw_replies", f"SELECT query_id, {_CALLED} AS called FROM raw_replies"))
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.raw_replies(spark, sf_dir).select(
        "query_id", R.tool_called(F.col("raw_reply"), F.col("user_query")).alias("called")
    )


@check("followup_prompts", using_all(["raw_replies", "shipping", "returns"], f"""
SELECT query_id, called, CASE WHEN called IS NOT NULL THEN concat('<|user|>', chr(10), coalesce(user_query, ''), chr(10), '<|assistant|>', chr(10), raw_reply,
  chr(10), chr(10), {text(V.TOOL_RESULT)}, CASE called WHEN 'shipping' THEN {_SHIPPING_TEXT} ELSE {_RETURNS_TEXT} END,
  chr(10), chr(10), {text(V.TOOL_INSTRUCTION)}) END AS followup_prompt
FROM (SELECT *, {category_sql('user_query')} AS category, {_CALLED} AS called FROM raw_replies) q
LEFT JOIN last_shipping s ON s.category = q.category LEFT JOIN last_returns r ON r.category = q.category""", *_LAST))
def followup_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recorded reply after a prompt of its question alone."""
    asked = F.array(F.struct(F.lit("user").alias("role"), F.col("user_query").alias("content")))
    replies = B.raw_replies(spark, sf_dir).withColumn("prompt", prompt_of(asked))
    return O.followup_prompts(replies, *B.policies(spark, sf_dir)).select("query_id", "called", "followup_prompt")


_READY = ("ready", f"""SELECT q.query_id, q.user_query, q.error, called, first, follow, low,
    {_SHIPPING_TEXT} AS shipping_text, {_RETURNS_TEXT} AS returns_text
  FROM (SELECT *, {category_sql('user_query')} AS category, {_CALLED} AS called, {_LOW} AS low,
      {clean_sql('raw_reply')} AS first,
      CASE WHEN followup_reply IS NULL THEN '' ELSE {untag_sql(clean_sql('followup_reply'))} END AS follow
    FROM raw_replies) q
  LEFT JOIN last_shipping s ON s.category = q.category LEFT JOIN last_returns r ON r.category = q.category""")


def _reply_sql(otherwise: str) -> str:
    return f"""CASE called WHEN 'shipping' THEN CASE WHEN follow <> '' THEN follow ELSE shipping_text END
      WHEN 'returns' THEN CASE WHEN follow <> '' THEN follow ELSE returns_text END ELSE {otherwise} END"""


_RESOLVED = _reply_sql(f"""CASE
  WHEN first = '' AND {any_of('low', V.SHORT_SHIPPING_WORDS)} THEN shipping_text
  WHEN first = '' AND {any_of('low', V.SHORT_RETURN_WORDS)} THEN returns_text
  WHEN {untag_sql('first')} = '' THEN {text(V.NO_INFORMATION)} ELSE {untag_sql('first')} END""")


@check("resolved_replies", using_all(
    ["raw_replies", "shipping", "returns"], f"SELECT query_id, {_RESOLVED} AS agent_reply FROM ready", *_LAST, _READY))
def resolved_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.resolve_reply(B.raw_replies(spark, sf_dir), *B.policies(spark, sf_dir)).select("query_id", "agent_reply")


@check("edge_case_replies", using_all(["raw_replies", "shipping", "returns"], f"""
SELECT query_id, user_query, CASE WHEN error IS NOT NULL THEN concat('ERROR: ', error)
  ELSE {_reply_sql('first')} END AS agent_reply FROM ready""", *_LAST, _READY))
def edge_case_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.edge_case_replies(B.raw_replies(spark, sf_dir), *B.policies(spark, sf_dir))
