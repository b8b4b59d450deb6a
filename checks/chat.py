"""Chat rows, conversations, prompts and retrieval."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit import vocabulary as V
from aislekit.operators import chat as O, retrieval
from aislekit.session import fresh_path
from aislekit.sources import vectors as S
from aislekit.streaming import dialogue, router
from checks import base as B
from checks.base import check, text, using

SYSTEM_PROMPT = "You answer questions on products of the shop."

# The message lists of the conversations, then lines with planted faults.
_CONVS = ("convs", """SELECT conv_id, to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR AS messages
  FROM conversations GROUP BY conv_id""")
_BAD_CONTENT = '{"messages":[{"role":"system","content":"a"},{"role":"user","content":"b"},{"role":"assistant","content":"c"},{"role":"user","content":5}]}'
_BLANK_CONTENT = '{"messages":[{"role":"system","content":"a"},{"role":"user","content":" \\t "},{"role":"assistant","content":"c"}]}'
_NO_ROLE = '{"messages":[{"role":"system","content":"a"},{"role":"user","content":"b"},{"role":"assistant","content":"c"},"x"]}'
_TWICE = '{"k":1,"k":2,"messages":[{"role":"system","content":"a"},{"role":"user","content":"b","content":"c"},{"role":"assistant","content":"d"}]}'
_NOT_A_NUMBER = '{"score":NaN,"messages":[{"role":"system","content":"a"},{"role":"user","content":"b"},{"role":"assistant","content":"d"}]}'
_LINE = f"""CASE conv_id % 17 WHEN 13 THEN {text(_TWICE)} WHEN 14 THEN {text(_NOT_A_NUMBER)} WHEN 0 THEN concat('{{bad', messages) WHEN 1 THEN '[1]' WHEN 2 THEN '{{"messages":"x"}}'
  WHEN 3 THEN '{{}}' WHEN 4 THEN {text(_BAD_CONTENT)} WHEN 5 THEN BLANK WHEN 6 THEN '   ' WHEN 7 THEN 'null'
  WHEN 8 THEN {text(_NO_ROLE)} ELSE concat('{{"messages":', messages, '}}') END"""
_LINES = ("lines", "SELECT conv_id AS line_no, " + _LINE.replace(
    "BLANK", text(_BLANK_CONTENT)) + " AS line FROM convs")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = O.conversations(B.table(spark, sf_dir, "conversations"))
    kind, messages = F.col("conv_id") % 17, F.to_json("messages")
    line = F.when(kind == 0, F.concat(F.lit("{bad"), messages))
    for k, fixed in ((1, "[1]"), (2, '{"messages":"x"}'), (3, "{}"), (4, _BAD_CONTENT), (5, _BLANK_CONTENT), (6, "   "), (7, "null"), (8, _NO_ROLE), (13, _TWICE), (14, _NOT_A_NUMBER)):
        line = line.when(kind == k, F.lit(fixed))
    line = line.otherwise(F.concat(F.lit('{"messages":'), messages, F.lit("}")))
    return convs.select(F.col("conv_id").alias("line_no"), line.alias("line"))


def _role_is(i: int, role: str) -> str:
    return f"coalesce(json_extract_string(safe, '$.messages[{i}].role') = '{role}', FALSE)"


_VERDICTS = ("verdicts", f"""SELECT line_no, coalesce(reason, '') = '' AS ok, coalesce(reason, '') AS reason FROM (
  SELECT line_no, CASE WHEN NOT json_valid(line) THEN {text(V.BAD_JSON)}
    WHEN json_type(safe) <> 'OBJECT' THEN {text(V.NOT_OBJECT)}
    WHEN coalesce(json_type(safe, '$.messages'), 'NONE') <> 'ARRAY' THEN {text(V.NO_MESSAGES)}
    WHEN json_array_length(safe, '$.messages') < 3 THEN {text(V.TOO_SHORT)}
    WHEN NOT ({_role_is(0, 'system')} AND {_role_is(1, 'user')} AND {_role_is(2, 'assistant')}) THEN {text(V.WRONG_ROLES)}
    ELSE (SELECT CASE WHEN bad_type THEN concat('Message ', i, ' missing string role/content')
        ELSE concat('Message ', i, ' content is empty') END FROM (
          SELECT i, coalesce(json_type(m, '$.role') <> 'VARCHAR' OR json_type(m, '$.content') <> 'VARCHAR'
              OR json_type(m, '$.role') IS NULL OR json_type(m, '$.content') IS NULL, TRUE) AS bad_type,
            regexp_matches(coalesce(json_extract_string(m, '$.content'), ''), '^\\s*$') AS blank
          FROM (SELECT unnest(json_extract(safe, '$.messages[*]')) AS m, generate_subscripts(json_extract(safe, '$.messages[*]'), 1) - 1 AS i))
        WHERE bad_type OR blank ORDER BY i LIMIT 1) END AS reason
  FROM (SELECT line_no, line, CASE WHEN json_valid(line) THEN line ELSE 'null' END AS safe
    FROM lines WHERE length(trim(line)) > 0))""")


@check("chat_verdicts", B.chain("SELECT line_no, ok, reason FROM verdicts", _CONVS, _LINES, _VERDICTS))
def chat_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.validate_chat(_lines(spark, sf_dir))


@check("chat_first_errors", B.chain("""SELECT line_no, concat('L', line_no, ': ', reason) AS error FROM verdicts
  WHERE NOT ok ORDER BY line_no LIMIT 20""", _CONVS, _LINES, _VERDICTS))
def chat_first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_errors(O.validate_chat(_lines(spark, sf_dir)), 20)


@check("chat_report", B.chain("""SELECT part, line_no, reason, (SELECT count(*) FROM counted WHERE place <= stop) AS total,
    (SELECT count(*) FROM counted WHERE place <= stop AND ok) AS ok
  FROM counted, ended WHERE NOT ok AND place <= stop""", _CONVS, _LINES, _VERDICTS,
    ("placed", "SELECT line_no, line_no % 7 AS part, row_number() OVER (PARTITION BY line_no % 7 ORDER BY line_no) AS nth FROM lines"),
    ("counted", """SELECT part, nth AS line_no, ok, reason, row_number() OVER w AS place, count(*) FILTER (NOT ok) OVER w AS failed
      FROM placed JOIN verdicts USING (line_no) WINDOW w AS (ORDER BY concat('part=', part, '/'), nth)"""),
    ("ended", f"SELECT coalesce(min(place) FILTER (failed >= 12 AND reason <> {text(V.BAD_JSON)}), max(place)) AS stop FROM counted")))
def chat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven files, checked in order until twelve lines have failed."""
    path = fresh_path(spark, "chat-lines")
    lines = _lines(spark, sf_dir).withColumn("part", F.col("line_no") % 7)
    lines.repartition("part").sortWithinPartitions("part", "line_no").select("part", F.col("line").alias("value")).write.partitionBy("part").text(path)
    report = O.validate_until(spark, path, 12)
    rows = [(int(re.search(r"part=([0-9]+)", file)[1]), line_no, reason, report.total, report.ok) for file, line_no, reason in report.errors]
    return spark.createDataFrame(rows, "part bigint, line_no bigint, reason string, total bigint, ok bigint")


@check("chat_summary", B.chain("""SELECT count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS errors
  FROM verdicts""", _CONVS, _LINES, _VERDICTS))
def chat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.validation_summary(O.validate_chat(_lines(spark, sf_dir)))


@check("chat_reasons", B.chain(
    "SELECT reason, count(*) AS n_rows FROM verdicts WHERE NOT ok GROUP BY reason", _CONVS, _LINES, _VERDICTS))
def chat_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.reasons_summary(O.validate_chat(_lines(spark, sf_dir)))


@check("prompts", """
SELECT conv_id, concat(coalesce(string_agg(concat('<|', role, '|>', chr(10), text, chr(10)), '' ORDER BY turn)
  FILTER (role IN ('system', 'user', 'assistant')), ''), '<|assistant|>', chr(10)) AS prompt
FROM conversations GROUP BY conv_id""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.format_prompt(B.table(spark, sf_dir, "conversations"))


# ---- retrieval ----------------------------------------------------------------------------

def _hits_sql(vectors: str) -> tuple[str, str]:
    """The last digits of a sum differ between engines: equal up to twelve counts as equal here."""
    return ("hits", f"""SELECT query_id, product_id, score, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS product_id,
    round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY
      round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS rank
  FROM embeddings q, {vectors} v) WHERE rank <= {V.TOP_K}""")


_HITS = _hits_sql("embeddings")
_PRODUCT_HITS = _hits_sql("(SELECT * FROM embeddings WHERE concat('P', vec_id) IN (SELECT product_id FROM library))")


def _hits(spark: SparkSession, sf_dir: str, threshold: float | None = None, products: DataFrame | None = None) -> DataFrame:
    """Every vector asks for its nearest ones; small chunks, so that several visit. Where `products` are
    given, only their vectors are offered."""
    rows = B.table(spark, sf_dir, "embeddings")
    offered = rows.select(F.col("vec_id").alias("product_id"), "embedding")
    if products is not None:
        offered = offered.join(
            products.select(F.substring("product_id", 2, 20).cast("bigint").alias("product_id")), "product_id", "left_semi"
        )
    asked = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.search(asked, offered, threshold=threshold, chunk_rows=1024)


@check("nearest_products", B.chain(
    "SELECT query_id, product_id, round(score, 6) AS score, rank FROM hits", _HITS))
def nearest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select(
        "query_id", "product_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


@check("nearest_products_above", B.chain(
    "SELECT query_id, product_id, rank FROM hits WHERE score >= 0.3", _HITS))
def nearest_products_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, 0.3).select("query_id", "product_id", F.col("rank").cast("bigint").alias("rank"))


_CONTEXT = ("context", f"""SELECT q.vec_id AS query_id, CASE WHEN count(l.product_id) = 0 THEN {text(V.NO_PRODUCTS)}
  ELSE concat({text(V.PRODUCTS_PREFIX)}, to_json(list({{'product_id': l.product_id, 'category': l.category, 'title': l.title,
    'price': l.price, 'brand': l.brand, 'features': l.features, 'avg_rating': l.avg_rating}} ORDER BY h.rank)
    FILTER (l.product_id IS NOT NULL))) END AS product_context
  FROM embeddings q LEFT JOIN hits h ON h.query_id = q.vec_id AND h.score >= 0.3
  LEFT JOIN library l ON l.product_id = concat('P', h.product_id) GROUP BY q.vec_id""")


def _product_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = B.library(spark, sf_dir)
    hits = _hits(spark, sf_dir, 0.3, products).withColumn("product_id", F.concat(F.lit("P"), F.col("product_id").cast("string")))
    asked = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"))
    found = hits.join(products, "product_id")
    return retrieval.context_json(asked.join(found, "query_id", "left"))


@check("product_contexts", using("library", "SELECT query_id, product_context FROM context", _PRODUCT_HITS, _CONTEXT))
def product_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product_contexts(spark, sf_dir)


@check("vector_store", B.chain("""SELECT vec_id AS product_id, label, len(embedding)::BIGINT AS n_numbers,
  array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)::BIGINT), ',') AS numbers FROM embeddings"""))
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "vectors")
    S.write_vectors(B.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "product_id"), path)
    return S.read_vectors(spark, path).select(
        "product_id", "label", F.size("embedding").cast("bigint").alias("n_numbers"),
        F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("bigint").cast("string")), ",").alias("numbers"),
    )


_TAGGED = "concat('<|', role, '|>', chr(10), text, chr(10))"


@check("shopper_prompts", using("library", f"""
SELECT c.conv_id, concat('<|system|>', chr(10), {text(SYSTEM_PROMPT)}, chr(10), coalesce(past, ''),
  '<|user|>', chr(10), 'Any news on this?', chr(10), chr(10),
  CASE WHEN product_context IS NULL THEN {text(V.NO_MATCH_INTRO)}
    ELSE concat({text(V.CONTEXT_INTRO)}, chr(10), product_context) END, chr(10), '<|assistant|>', chr(10)) AS prompt
FROM (SELECT conv_id, string_agg({_TAGGED}, '' ORDER BY turn) FILTER (length(text) > 0 AND role IN ('user', 'assistant')) AS past
  FROM conversations GROUP BY conv_id) c LEFT JOIN context ON query_id = conv_id""", _PRODUCT_HITS, _CONTEXT))
def shopper_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation goes on with one more question; its id is also the id of the query vector."""
    turns = B.table(spark, sf_dir, "conversations")
    found = _product_contexts(spark, sf_dir).withColumnRenamed("query_id", "conv_id")
    asked = turns.select("conv_id", F.lit("Any news on this?").alias("query")).distinct()
    messages = O.assemble_messages(asked.join(found, "conv_id", "left"), turns, SYSTEM_PROMPT)
    return messages.select("conv_id", O.prompt_of(F.col("messages")).alias("prompt"))


_DIALOGUE_SQL = f"""SELECT conv_id, turn, concat('<|system|>', chr(10), {text(SYSTEM_PROMPT)}, chr(10), coalesce(past, ''), '<|user|>', chr(10), text, chr(10), chr(10),
  CASE WHEN turn % 2 = 0 THEN concat({text(V.CONTEXT_INTRO)}, chr(10), 'Turn ', turn) ELSE {text(V.NO_MATCH_INTRO)} END, chr(10), '<|assistant|>', chr(10)) AS prompt
FROM (SELECT *, string_agg({_TAGGED}, '') FILTER (length(text) > 0 AND role IN ('user', 'assistant')) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM conversations) WHERE role = 'user'"""


@check("streamed_dialogues", _DIALOGUE_SQL)
def streamed_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn asks. The turns arrive in two files; the stream stops between them and goes on from its state."""
    asks = F.col("role") == "user"
    turns = B.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", F.timestamp_seconds(1_700_000_000 + F.col("turn") * 60).alias("at"), asks.alias("asks"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Turn "), "turn")).alias("product_context"))
    path, out = fresh_path(spark, "turns"), fresh_path(spark, "dialogues")
    for part in (F.col("turn") < 3, F.col("turn") >= 3):
        turns.where(part).write.mode("append").parquet(path)
        stream = dialogue.stream_messages(spark.readStream.schema(turns.schema).parquet(path), SYSTEM_PROMPT)
        router.write_stream(stream, out, out + "-offsets").awaitTermination()
    return spark.read.parquet(out).select("conv_id", "turn", O.prompt_of(F.col("messages")).alias("prompt"))
