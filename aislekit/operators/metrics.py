"""Scored test runs and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aislekit import vocabulary as V
from aislekit.functions import evaluation as E
from aislekit.functions.text import is_blank


def evaluate_runs(runs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One result row per test, with the columns `keep` beside; a failed run carries only the error mark.

    A test column that the table lacks counts as 0 or empty (`sources.runs` settles it per line).
    A null question fails the run, as does a null price or rating that a rule needs.
    """
    def have(name: str, missing: Column) -> Column:
        return F.col(name) if name in runs.columns else missing

    reply = F.coalesce(F.col("agent_reply"), F.lit(""))
    query = F.col("user_query")
    finding = E.evaluate_reply(
        query, reply,
        title=have("title", F.lit("")), price=have("price", F.lit(0.0)), brand=have("brand", F.lit("")),
        features=have("features", F.array().cast("array<string>")), avg_rating=have("avg_rating", F.lit(0.0)),
    )
    error = have("error", F.lit(None).cast("string"))
    scored = runs.withColumn("finding", F.when(error.isNull(), finding)).withColumn(
        "failure", F.coalesce(error, F.when(query.isNull(), F.lit(V.NO_QUESTION)), F.col("finding.failure"))
    )
    failed = F.col("failure").isNotNull()

    def unless_failed(value: Column, name: str) -> Column:
        return F.when(~failed, value).alias(name)

    found = F.col("finding")
    evaluation = F.struct(
        unless_failed(E.query_type(query), "query_type"),
        *[
            unless_failed(found[name], name)
            for name in (
                "is_helpful", "is_accurate", "is_complete", "is_relevant", "confidence_score", "issues", "strengths",
            )
        ],
        unless_failed(F.length(reply).cast("bigint"), "response_length"),
        unless_failed(is_blank(reply), "is_empty"),
        unless_failed(E.contains_error_narrow(reply), "contains_error"),
        failed.alias("error"),
    )
    return scored.select(
        "test_id", "product_id", "title", "user_query",
        F.when(failed, F.concat(F.lit("ERROR: "), F.col("failure"))).otherwise(reply).alias("agent_reply"),
        F.when(failed, F.lit(0.0)).otherwise(F.col("response_time")).alias("response_time"),
        evaluation.alias("evaluation"), *keep,
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _latency() -> list[Column]:
    time = F.col("response_time")
    timed = F.count_if(time > 0)
    return [
        F.coalesce(F.avg(F.when(time > 0, time)), F.lit(0.0)).alias("avg_response_time"),
        _share(F.count_if((time > 0) & (time <= V.LATENCY_TARGET_SECONDS)), timed).alias("response_time_compliance"),
    ]


def _totals() -> list[Column]:
    total = F.count(F.lit(1))
    good = F.count_if(~F.col("evaluation.error"))

    def flagged(name: str) -> Column:
        return F.count_if(F.coalesce(F.col(f"evaluation.{name}"), F.lit(False)))

    return [
        total.alias("total_tests"),
        good.alias("successful_tests"),
        _share(good, total).alias("success_rate"),
        _share(flagged("is_empty"), total).alias("empty_response_rate"),
        _share(flagged("contains_error"), total).alias("error_response_rate"),
    ]


def run_metrics(results: DataFrame) -> DataFrame:
    """One row: totals and rates."""
    return results.agg(*_totals())


def latency_metrics(results: DataFrame) -> DataFrame:
    """One row: mean time of timed replies and the share within the target."""
    return results.agg(*_latency())


def accuracy_by_type(results: DataFrame) -> DataFrame:
    """(query_type, n_tests, accuracy); failed runs fall under `unknown`."""
    accurate = F.coalesce(F.col("evaluation.is_accurate"), F.lit(False))
    return (
        results.groupBy(F.coalesce("evaluation.query_type", F.lit("unknown")).alias("query_type"))
        .agg(F.count(F.lit(1)).alias("n_tests"), F.avg(accurate.cast("double")).alias("accuracy"))
    )


def all_metrics(results: DataFrame) -> DataFrame:
    """The whole metrics document as one row; it has nine query types at most."""
    types = accuracy_by_type(results).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("query_type", "accuracy")))).alias("by_type")
    ).scalar()
    numbers = results.agg(*_totals(), *_latency())
    return numbers.select(
        "total_tests", "successful_tests", "success_rate", "empty_response_rate", "error_response_rate",
        types.alias("query_type_accuracy"), "avg_response_time", "response_time_compliance",
    )
