"""Scores of replies and the metrics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit import vocabulary as V
from aislekit.functions import evaluation as E
from aislekit.operators import metrics as O
from aislekit.plans import jobs
from aislekit.session import fresh_path
from aislekit.sources import jsonl, runs
from aislekit.streaming import metrics as arriving
from checks import base as B
from checks.base import ORACLES, check, text, using
from checks.routing import any_of

_Q, _R = "lower(user_query)", "lower(agent_reply)"
_INTENT = f"""CASE WHEN {any_of(_Q, V.PRICE_INTENT)} THEN 'price_inquiry' WHEN {any_of(_Q, V.RATING_INTENT)} THEN 'rating_inquiry'
  WHEN {any_of(_Q, V.BRAND_INTENT)} THEN 'brand_inquiry' WHEN contains({_Q}, 'features') THEN 'feature_inquiry'
  WHEN starts_with({_Q}, 'is ') OR starts_with({_Q}, 'does ') OR starts_with({_Q}, 'has ') THEN 'feature_check'
  WHEN {any_of(_Q, V.SHIPPING_INTENT)} THEN 'shipping_inquiry' WHEN {any_of(_Q, V.RETURN_INTENT)} THEN 'return_inquiry'
  ELSE 'general_inquiry' END"""
_TYPE = f"""CASE WHEN {any_of(_Q, V.PRICE_TYPE)} THEN 'price' WHEN {any_of(_Q, V.RATING_TYPE)} THEN 'rating'
  WHEN {any_of(_Q, V.BRAND_TYPE)} THEN 'brand' WHEN contains({_Q}, 'features') THEN 'features'
  WHEN {any_of(_Q, V.SHIPPING_TYPE)} THEN 'shipping' WHEN {any_of(_Q, V.RETURN_TYPE)} THEN 'return_policy'
  WHEN {any_of(_Q, V.CHECK_TYPE)} THEN 'feature_check' ELSE 'general' END"""


def _found(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(agent_reply, {text('(?i)' + p)})" for p in patterns) + ")"


_ASKED = "CASE " + " ".join(
    f"WHEN contains({_Q}, {text(f)}) THEN {text(f)}" for f in V.CHECKED_FEATURES
) + " END"

# Facts of every reply, then one set of columns per rule.
_FACTS = ("facts", f"""SELECT *, {_INTENT} AS intent, {_R} AS low, length(agent_reply) AS n,
  {_found(V.PRICE_PATTERNS)} AS price_found, {_found(V.RATING_PATTERNS)} AS rating_found,
  {_found(V.BRAND_PATTERNS)} AS brand_found, contains({_R}, 'feature') AS feature_found,
  list_filter(features, lambda f: contains({_R}, lower(f))) AS named,
  {_ASKED} AS asked, {any_of(_R, V.YES_WORDS)} AS yes, {any_of(_R, V.NO_WORDS)} AS no,
  list_contains(list_transform(features, lambda f: lower(f)), {_ASKED}) AS has,
  {any_of(_R, V.SHIPPING_REPLY_WORDS)} AS ship_found, {any_of(_R, V.RETURN_REPLY_WORDS)} AS return_found,
  contains({_R}, 'product') OR contains({_R}, lower(title)) AS mentioned
  FROM test_cases""")


def _number_rule(name: str, column: str, relevant: str) -> str:
    found, good = f"{name}_found", f"({name}_found AND {column} > 0 AND contains(agent_reply, {column}::VARCHAR))"
    return f"""SELECT test_id, '{name}' AS rule, {good} OR ({found} AND {column} = 0) AS helpful, {good} AS accurate,
      {found} AND n > 20 AS complete, {relevant} AS relevant,
      CASE WHEN NOT {found} THEN 'No {name} information found'
        WHEN {column} <= 0 THEN '{name.capitalize()} information present but no expected {name} to compare'
        WHEN NOT {good} THEN '{name.capitalize()} information present but inaccurate' ELSE '' END AS issues,
      CASE WHEN {good} THEN 'Accurate {name} information' ELSE '' END AS strengths,
      {found} AND {column} IS NULL AS broken FROM facts"""


_RULES = {
    "price": _number_rule("price", "price", "contains(low, 'price') OR contains(low, '$')"),
    "rating": _number_rule("rating", "avg_rating", "contains(low, 'rating') OR contains(low, 'star')"),
    "brand": """SELECT test_id, 'brand' AS rule, brand_found AND (brand = '' OR contains(low, lower(brand))) AS helpful,
      brand_found AND brand <> '' AND contains(low, lower(brand)) AS accurate, brand_found AND n > 20 AS complete,
      contains(low, 'brand') AS relevant,
      CASE WHEN NOT brand_found THEN 'No brand information found'
        WHEN brand = '' THEN 'Brand information present but no expected brand to compare'
        WHEN NOT contains(low, lower(brand)) THEN 'Brand information present but inaccurate' ELSE '' END AS issues,
      CASE WHEN brand_found AND brand <> '' AND contains(low, lower(brand)) THEN 'Accurate brand information' ELSE '' END AS strengths,
      FALSE AS broken FROM facts""",
    "features": """SELECT test_id, 'features' AS rule, feature_found AND (len(features) = 0 OR len(named) > 0) AS helpful,
      feature_found AND len(named) > 0 AS accurate, feature_found AND n > 30 AS complete, feature_found AS relevant,
      CASE WHEN NOT feature_found THEN 'No feature information found'
        WHEN len(features) = 0 THEN 'Feature information present but no expected features to compare'
        WHEN len(named) = 0 THEN 'Feature information present but doesn''t match expected features' ELSE '' END AS issues,
      CASE WHEN feature_found AND len(named) > 0 THEN concat('Found features: ', array_to_string(named, ', ')) ELSE '' END AS strengths,
      FALSE AS broken FROM facts""",
    "feature_check": """SELECT test_id, 'feature_check' AS rule, asked IS NOT NULL AND (yes OR no) AS helpful,
      asked IS NOT NULL AND ((has AND yes) OR (NOT has AND no)) AS accurate,
      asked IS NOT NULL AND (yes OR no) AND n > 20 AS complete, coalesce(contains(low, asked), FALSE) AS relevant,
      CASE WHEN asked IS NULL THEN 'Could not identify specific feature being asked about'
        WHEN NOT (yes OR no) THEN 'Response doesn''t clearly answer yes/no'
        WHEN has AND NOT yes THEN concat('Incorrectly denied ', asked, ' feature')
        WHEN NOT has AND NOT no THEN concat('Incorrectly claimed ', asked, ' feature') ELSE '' END AS issues,
      CASE WHEN asked IS NULL THEN '' WHEN has AND yes THEN concat('Correctly identified ', asked, ' feature')
        WHEN NOT has AND no THEN concat('Correctly identified absence of ', asked, ' feature') ELSE '' END AS strengths,
      FALSE AS broken FROM facts""",
    "shipping": """SELECT test_id, 'shipping' AS rule, ship_found AS helpful, TRUE AS accurate, ship_found AND n > 30 AS complete,
      contains(low, 'shipping') OR contains(low, 'delivery') AS relevant,
      CASE WHEN ship_found THEN '' ELSE 'No shipping information found' END AS issues,
      CASE WHEN ship_found THEN 'Contains shipping information' ELSE '' END AS strengths, FALSE AS broken FROM facts""",
    "returns": """SELECT test_id, 'returns' AS rule, return_found AS helpful, TRUE AS accurate, return_found AND n > 30 AS complete,
      contains(low, 'return') OR contains(low, 'policy') AS relevant,
      CASE WHEN return_found THEN '' ELSE 'No return policy information found' END AS issues,
      CASE WHEN return_found THEN 'Contains return policy information' ELSE '' END AS strengths, FALSE AS broken FROM facts""",
    "general": """SELECT test_id, 'general' AS rule, n > 10 AS helpful, TRUE AS accurate, n > 30 AS complete, mentioned AS relevant,
      concat_ws('|', CASE WHEN n < 10 THEN 'Response too short' END,
        CASE WHEN NOT mentioned THEN 'Response doesn''t mention the product' END) AS issues,
      concat_ws('|', CASE WHEN n >= 10 THEN 'Response has adequate length' END,
        CASE WHEN mentioned THEN 'Response mentions the product' END) AS strengths, FALSE AS broken FROM facts""",
}
_CONFIDENCE = """round(CASE WHEN helpful THEN 0.3 ELSE 0 END + CASE WHEN accurate THEN 0.3 ELSE 0 END
  + CASE WHEN complete THEN 0.2 ELSE 0 END + CASE WHEN relevant THEN 0.2 ELSE 0 END, 6)::DOUBLE"""
_FINDING_COLUMNS = f"""test_id, coalesce(helpful, FALSE) AS is_helpful, coalesce(accurate, FALSE) AS is_accurate,
  complete AS is_complete, relevant AS is_relevant, {_CONFIDENCE} AS confidence_score, issues, strengths"""


def _finding(df: DataFrame, finding) -> DataFrame:
    f = F.col("finding")
    return df.select("test_id", finding.alias("finding")).select(
        "test_id", "finding.is_helpful", "finding.is_accurate", "finding.is_complete", "finding.is_relevant",
        F.round(f["confidence_score"], 6).alias("confidence_score"),
        F.array_join(f["issues"], "|").alias("issues"), F.array_join(f["strengths"], "|").alias("strengths"),
    )


@check("price_scores", using("test_cases", f"SELECT {_FINDING_COLUMNS} FROM rule",
       ("facts", _FACTS[1].replace("SELECT *,", "SELECT * REPLACE (coalesce(price, 0.0) AS price),")), ("rule", _RULES["price"])))
def price_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing price counts as 0 here, as in a table without the column."""
    return _finding(B.test_cases(spark, sf_dir), E.eval_price(F.col("agent_reply"), F.coalesce("price", F.lit(0.0))))


@check("rating_scores", using("test_cases", f"SELECT {_FINDING_COLUMNS} FROM rule",
       ("facts", _FACTS[1].replace("SELECT *,", "SELECT * REPLACE (coalesce(avg_rating, 0.0) AS avg_rating),")), ("rule", _RULES["rating"])))
def rating_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finding(B.test_cases(spark, sf_dir), E.eval_rating(F.col("agent_reply"), F.coalesce("avg_rating", F.lit(0.0))))


@check("brand_scores", using("test_cases", f"SELECT {_FINDING_COLUMNS} FROM rule", _FACTS, ("rule", _RULES["brand"])))
def brand_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finding(B.test_cases(spark, sf_dir), E.eval_brand(F.col("agent_reply"), F.col("brand")))


@check("feature_scores", using("test_cases", f"SELECT {_FINDING_COLUMNS} FROM rule", _FACTS, ("rule", _RULES["features"])))
def feature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finding(B.test_cases(spark, sf_dir), E.eval_features(F.col("agent_reply"), F.col("features")))


@check("feature_check_scores", using("test_cases", f"SELECT {_FINDING_COLUMNS} FROM rule", _FACTS, ("rule", _RULES["feature_check"])))
def feature_check_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finding(
        B.test_cases(spark, sf_dir), E.eval_feature_check(F.col("user_query"), F.col("agent_reply"), F.col("features"))
    )


@check("shipping_scores", using("test_cases", f"SELECT {_FINDING_COLUMNS} FROM rule", _FACTS, ("rule", _RULES["shipping"])))
def shipping_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finding(B.test_cases(spark, sf_dir), E.eval_shipping(F.col("agent_reply")))


@check("returns_scores", using("test_cases", f"SELECT {_FINDING_COLUMNS} FROM rule", _FACTS, ("rule", _RULES["returns"])))
def returns_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finding(B.test_cases(spark, sf_dir), E.eval_returns(F.col("agent_reply")))


@check("general_scores", using("test_cases", f"SELECT {_FINDING_COLUMNS} FROM rule", _FACTS, ("rule", _RULES["general"])))
def general_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finding(B.test_cases(spark, sf_dir), E.eval_general(F.col("agent_reply"), F.col("title")))


@check("query_classes", using("test_cases", f"""
SELECT test_id, {_INTENT} AS intent, {_TYPE} AS query_type, {any_of(_R, V.ERROR_PHRASES_WIDE)} AS error_wide,
  {any_of(_R, V.ERROR_PHRASES_NARROW)} AS error_narrow FROM test_cases"""))
def query_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    query, reply = F.col("user_query"), F.col("agent_reply")
    return B.test_cases(spark, sf_dir).select(
        "test_id", E.query_intent(query).alias("intent"), E.query_type(query).alias("query_type"),
        E.contains_error_wide(reply).alias("error_wide"), E.contains_error_narrow(reply).alias("error_narrow"),
    )


_INTENT_RULES = {
    "price_inquiry": "price", "rating_inquiry": "rating", "brand_inquiry": "brand", "feature_inquiry": "features",
    "feature_check": "feature_check", "shipping_inquiry": "shipping", "return_inquiry": "returns", "general_inquiry": "general",
}
_RULE_OF = "CASE " + " ".join(f"WHEN intent = '{i}' THEN '{r}'" for i, r in _INTENT_RULES.items()) + " END"
_SCORED = ("scored", f"""SELECT f.*, {_RULE_OF} AS rule,
  length(trim(agent_reply)) = 0 AS is_empty, {any_of('low', V.ERROR_PHRASES_WIDE)} AS wide FROM facts f""")
_ALL_RULES = ("rules", " UNION ALL ".join(_RULES.values()))
_RESULTS = ("results", f"""SELECT test_id, product_id, title, user_query,
    CASE WHEN failure IS NOT NULL THEN concat('ERROR: ', failure) ELSE agent_reply END AS agent_reply,
    CASE WHEN failure IS NOT NULL THEN 0.0::DOUBLE ELSE response_time END AS response_time,
    CASE WHEN failure IS NULL THEN {_TYPE} END AS query_type,
    CASE WHEN failure IS NULL THEN plain AND coalesce(helpful, FALSE) END AS is_helpful,
    CASE WHEN failure IS NULL THEN plain AND coalesce(accurate, FALSE) END AS is_accurate,
    CASE WHEN failure IS NULL THEN plain AND complete END AS is_complete,
    CASE WHEN failure IS NULL THEN plain AND relevant END AS is_relevant,
    CASE WHEN failure IS NULL THEN CASE WHEN plain THEN {_CONFIDENCE} ELSE 0.0::DOUBLE END END AS confidence_score,
    CASE WHEN failure IS NULL THEN CASE WHEN is_empty THEN 'Empty response' WHEN wide THEN 'Contains error' ELSE issues END END AS issues,
    CASE WHEN failure IS NULL THEN CASE WHEN plain THEN strengths ELSE '' END END AS strengths,
    CASE WHEN failure IS NULL THEN n END AS response_length, CASE WHEN failure IS NULL THEN is_empty END AS is_empty,
    CASE WHEN failure IS NULL THEN {any_of('low', V.ERROR_PHRASES_NARROW)} END AS contains_error, failure IS NOT NULL AS error
  FROM (SELECT s.*, r.* EXCLUDE (test_id, rule), NOT is_empty AND NOT wide AS plain,
      CASE WHEN s.error IS NOT NULL THEN s.error WHEN NOT is_empty AND NOT wide AND broken
        THEN '''>'' not supported between instances of ''NoneType'' and ''int''' END AS failure
    FROM scored s JOIN rules r ON r.test_id = s.test_id AND r.rule = s.rule)""")
_CHAIN = (_FACTS, _SCORED, _ALL_RULES, _RESULTS)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.evaluate_runs(B.test_cases(spark, sf_dir))


@check("evaluated_runs", using("test_cases", """SELECT test_id, product_id, title, user_query, agent_reply,
  round(response_time, 6) AS response_time, query_type, is_helpful, is_accurate, is_complete, is_relevant, confidence_score,
  issues, strengths, response_length, is_empty, contains_error, error FROM results""", *_CHAIN))
def evaluated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("evaluation")
    return _results(spark, sf_dir).select(
        "test_id", "product_id", "title", "user_query", "agent_reply", F.round("response_time", 6).alias("response_time"),
        "evaluation.query_type", "evaluation.is_helpful", "evaluation.is_accurate", "evaluation.is_complete",
        "evaluation.is_relevant", F.round(e["confidence_score"], 6).alias("confidence_score"),
        F.array_join(e["issues"], "|").alias("issues"), F.array_join(e["strengths"], "|").alias("strengths"),
        "evaluation.response_length", "evaluation.is_empty", "evaluation.contains_error", "evaluation.error",
    )


_PUBLISHED = ("published", """SELECT * REPLACE ('' AS brand, 0.0::DOUBLE AS avg_rating,
  CASE WHEN price IS NULL THEN NULL ELSE price END AS price) FROM test_cases""")


@check("published_runs", using("test_cases", """SELECT product_id, title, user_query, agent_reply, query_type, is_helpful, is_accurate,
  is_complete, is_relevant, confidence_score, issues, strengths, error FROM results""",
    _PUBLISHED, ("facts", _FACTS[1].replace("FROM test_cases", "FROM published")), *_CHAIN[1:]))
def published_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written as lines without test_id, brand and avg_rating, nulls written out, and read back."""
    path = fresh_path(spark, "runs")
    jsonl.write_jsonl(B.test_cases(spark, sf_dir).drop("test_id", "brand", "avg_rating"), path)
    e = F.col("evaluation")
    return O.evaluate_runs(runs.read_test_cases(spark, path)).select(
        "product_id", "title", "user_query", "agent_reply", "evaluation.query_type", "evaluation.is_helpful", "evaluation.is_accurate",
        "evaluation.is_complete", "evaluation.is_relevant", F.round(e["confidence_score"], 6).alias("confidence_score"),
        F.array_join(e["issues"], "|").alias("issues"), F.array_join(e["strengths"], "|").alias("strengths"), "evaluation.error",
    )


_TOTALS = """count(*) AS total_tests, count(*) FILTER (NOT error) AS successful_tests,
  round(count(*) FILTER (NOT error) / count(*), 6) AS success_rate,
  round(count(*) FILTER (is_empty) / count(*), 6) AS empty_response_rate,
  round(count(*) FILTER (contains_error) / count(*), 6) AS error_response_rate"""
_LATENCY = """round(coalesce(avg(response_time) FILTER (response_time > 0), 0.0), 6) AS avg_response_time,
  round(coalesce(count(*) FILTER (response_time > 0 AND response_time <= 2.0)
    / nullif(count(*) FILTER (response_time > 0), 0), 0.0), 6) AS response_time_compliance"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@check("run_metrics", using("test_cases", f"SELECT {_TOTALS} FROM results", *_CHAIN))
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(O.run_metrics(_results(spark, sf_dir)))


@check("latency_metrics", using("test_cases", f"SELECT {_LATENCY} FROM results", *_CHAIN))
def latency_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(O.latency_metrics(_results(spark, sf_dir)))


_BY_TYPE = """SELECT coalesce(query_type, 'unknown') AS query_type, count(*) AS n_tests,
  round(avg(CASE WHEN is_accurate THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM results GROUP BY 1"""


@check("accuracy_by_type", using("test_cases", _BY_TYPE, *_CHAIN))
def accuracy_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(O.accuracy_by_type(_results(spark, sf_dir)))


def _document(metrics: DataFrame) -> DataFrame:
    """A metrics row with its accuracies as one text."""
    entries = F.array_sort(F.map_entries("query_type_accuracy"))
    told = F.transform(entries, lambda e: F.concat(
        e["key"], F.lit("="), F.call_function("format_number", e["value"], F.lit("0.0000"))
    ))
    return _rounded(metrics.withColumn("accuracy", F.array_join(told, "|")).drop("query_type_accuracy"))


@check("metrics_document", using("test_cases", f"""SELECT {_TOTALS}, {_LATENCY},
  (SELECT string_agg(concat(query_type, '=', printf('%.4f', accuracy)), '|' ORDER BY query_type) FROM by_type) AS accuracy
  FROM results""", *_CHAIN, ("by_type", _BY_TYPE)))
def metrics_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as one JSON document and read back."""
    path = fresh_path(spark, "metrics")
    _, metrics = jobs.test_report(B.test_cases(spark, sf_dir))
    jsonl.write_metrics(metrics, path)
    back = jsonl.read_jsonl(spark, path, metrics.schema)
    return _document(back)


@check("streamed_metrics", ORACLES["metrics_document"])
def streamed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs in three files, the second also holding runs of the first again; the stream stops between them."""
    cases = B.test_cases(spark, sf_dir).withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("test_id") % 3600))
    path, out = fresh_path(spark, "runs"), fresh_path(spark, "counts")
    kind = F.col("test_id") % 3
    for part in (kind == 0, (kind == 1) | (F.col("test_id") % 6 == 0), kind == 2):
        cases.where(part).write.mode("append").parquet(path)
        results = O.evaluate_runs(spark.readStream.schema(cases.schema).parquet(path), keep=("at",))
        arriving.write_counts(arriving.stream_counts(results), out, out + "-offsets").awaitTermination()
    return _document(arriving.counted_metrics(spark, out))
