"""Routing a stream of shopper questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from aislekit.operators.replies import bounded, policy_lookup
from aislekit.session import written


def route_stream(
    stream: DataFrame, shipping: DataFrame, returns: DataFrame, query: str = "user_query"
) -> DataFrame:
    """The stream with route, category and policy text.

    Stateless: a join with two static tables of five rows at most, so append mode works,
    a restart needs nothing but the source offsets, and the rows equal the batch result.
    The policy rows are written once, not found anew for every micro-batch.
    """
    return policy_lookup(stream, written(bounded(shipping), "policies"), written(bounded(returns), "policies"), query)


def write_stream(routed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the routed rows to a Parquet table, taking all that is there, then stop."""
    return (
        routed.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", path)
        .trigger(availableNow=True).start()
    )
