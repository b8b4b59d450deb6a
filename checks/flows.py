"""Whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit import vocabulary as V
from aislekit.plans import jobs
from aislekit.session import written
from checks import base as B
from checks.base import ORACLES, check, text, using_all
from checks.chat import SYSTEM_PROMPT
from checks.routing import _LAST, _RETURNS_TEXT, _SHIPPING_TEXT, category_sql, route_sql

_KINDS = {"pick_one": "satisfying_ids, NULL AS reply", "pick_list": "predicted_ids, reply",
          "reject": "predicted_ids, reply", "clarify": "NULL, reply"}


@check("review_set", " UNION ALL ".join(
    f"SELECT ctx_id, '{kind}' AS source, task, query, {rest.replace(',', ' AS answer_ids,', 1)} FROM ({ORACLES[kind + '_tasks']})"
    for kind, rest in _KINDS.items()))
def review_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four kinds over the same contexts."""
    contexts = written(B.contexts(spark, sf_dir), "contexts")
    made = jobs.review_tasks(contexts, dict.fromkeys(jobs.GENERATORS), B.SEED)
    return jobs.review_set(made).select(
        "ctx_id", "source", "task", "query", F.array_join("answer_ids", "|").alias("answer_ids"), "reply"
    )


_ASKED_SQL = """SELECT conv_id AS query_id, conv_id,
  CASE conv_id % 4 WHEN 0 THEN 'How long does shipping take for tools?' WHEN 1 THEN 'Can I get a refund on coffee?'
    ELSE 'Any news on this?' END AS user_query FROM (SELECT DISTINCT conv_id FROM {conversations})"""


@check("shopper_answers", using_all(["raw_meta", "library", "shipping", "returns"], f"""
SELECT q.query_id, route, CASE route WHEN 'shipping' THEN {_SHIPPING_TEXT} WHEN 'returns' THEN {_RETURNS_TEXT} END AS policy_text,
  CASE route WHEN 'search' THEN concat('<|system|>', chr(10), {text(SYSTEM_PROMPT)}, chr(10), coalesce(past, ''),
    '<|user|>', chr(10), user_query, chr(10), chr(10), CASE WHEN product_context IS NULL THEN {text(V.NO_MATCH_INTRO)}
      ELSE concat({text(V.CONTEXT_INTRO)}, chr(10), product_context) END, chr(10), '<|assistant|>', chr(10)) END AS prompt
FROM asked q LEFT JOIN last_shipping s ON s.category = q.category LEFT JOIN last_returns r ON r.category = q.category
LEFT JOIN past ON past.conv_id = q.conv_id LEFT JOIN context x ON x.query_id = q.query_id""", *_LAST,
    ("asked", f"""SELECT a.*, {route_sql('user_query')} AS route, {category_sql('user_query')} AS category, embedding
      FROM ({_ASKED_SQL.replace('{conversations}', 'conversations')}) a LEFT JOIN embeddings ON vec_id = query_id"""),
    ("past", """SELECT conv_id, string_agg(concat('<|', role, '|>', chr(10), text, chr(10)), '' ORDER BY turn) AS past
      FROM conversations WHERE length(text) > 0 AND role IN ('user', 'assistant') GROUP BY conv_id"""),
    ("near", f"""SELECT query_id, v.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY
        round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) DESC, concat('P', v.vec_id)) AS rank
      FROM asked q, embeddings v WHERE route = 'search' AND q.embedding IS NOT NULL AND concat('P', v.vec_id) IN (SELECT product_id FROM library)
      QUALIFY rank <= {V.TOP_K}"""),
    ("context", f"""SELECT query_id, concat({text(V.PRODUCTS_PREFIX)}, to_json(list({{'product_id': l.product_id, 'category': l.category,
        'title': l.title, 'price': l.price, 'brand': l.brand, 'features': l.features, 'avg_rating': l.avg_rating}} ORDER BY rank))) AS product_context
      FROM near JOIN library l ON l.product_id = concat('P', vec_id) GROUP BY query_id""")))
def shopper_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation goes on with a question; its vector, if there is one, is the one with the same number."""
    turns, rows = B.table(spark, sf_dir, "conversations"), B.table(spark, sf_dir, "embeddings")
    queries = B._run(spark, _ASKED_SQL, conversations=turns).join(
        rows.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left"
    )
    vectors = rows.select(F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("product_id"), "embedding")
    return jobs.answer_shoppers(
        queries, vectors, B.library(spark, sf_dir), turns, *B.policies(spark, sf_dir), SYSTEM_PROMPT
    )
