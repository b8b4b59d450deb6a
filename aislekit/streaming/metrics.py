"""Metrics of test runs while their results arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from aislekit import vocabulary as V

#: How late a result may come or come again, and the event time that one row of counts covers.
LATE, WIDTH = "1 hour", "1 hour"


def stream_counts(results: DataFrame, at: str = "at", late: str = LATE, width: str = WIDTH) -> DataFrame:
    """Counts of a stream of result rows (see `operators.metrics.evaluate_runs`) by event time and query type.

    A test_id counts once among the rows of `late` of event time; what comes later than that is dropped. All
    is kept as sums, so that rates of any time are rates of sums. State is bounded by the windows still open.
    """
    time, e = F.col("response_time"), F.col("evaluation")

    def flagged(name: str):
        return F.count_if(F.coalesce(e[name], F.lit(False)))

    once = results.withWatermark(at, late).dropDuplicatesWithinWatermark(["test_id"])
    return once.groupBy(F.window(at, width).alias("window"), F.coalesce(e["query_type"], F.lit("unknown")).alias("query_type")).agg(
        F.count(F.lit(1)).alias("tests"), F.count_if(~e["error"]).alias("successful"), flagged("is_empty").alias("empty"),
        flagged("contains_error").alias("erring"), flagged("is_accurate").alias("accurate"), F.count_if(time > 0).alias("timed"),
        F.coalesce(F.sum(F.when(time > 0, time)), F.lit(0.0)).alias("seconds"),
        F.count_if((time > 0) & (time <= V.LATENCY_TARGET_SECONDS)).alias("in_time"),
    )


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts that each batch changes, taking all that is there, then stop. A batch done again replaces its own rows."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics document (see `operators.metrics.all_metrics`) of all counts kept so far: the last ones of each window."""
    stored = spark.read.option("basePath", path).parquet(path)
    names = [c for c in stored.columns if c not in ("window", "query_type", "batch")]
    last = stored.groupBy("window", "query_type").agg(F.max_by(F.struct(*names), "batch").alias("last")).select("query_type", "last.*")
    by_type = last.groupBy("query_type").agg(*[F.sum(n).alias(n) for n in names])  # nine types at most

    def share(part: str, whole: str):
        return F.when(F.sum(whole) > 0, F.sum(part) / F.sum(whole)).otherwise(F.lit(0.0))

    return by_type.agg(
        F.coalesce(F.sum("tests"), F.lit(0)).alias("total_tests"), F.coalesce(F.sum("successful"), F.lit(0)).alias("successful_tests"),
        share("successful", "tests").alias("success_rate"), share("empty", "tests").alias("empty_response_rate"),
        share("erring", "tests").alias("error_response_rate"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("query_type", (F.col("accurate") / F.col("tests")).alias("accuracy"))))).alias("query_type_accuracy"),
        share("seconds", "timed").alias("avg_response_time"), share("in_time", "timed").alias("response_time_compliance"),
    )
