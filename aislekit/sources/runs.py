"""Recorded test runs as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aislekit import schemas
from aislekit.sources.jsonl import read_numbered_lines

# What a field counts as where a line lacks it; a null that is written out stays null.
_ABSENT = {"title": "", "price": 0.0, "brand": "", "avg_rating": 0.0, "agent_reply": "", "user_query": "", "response_time": 0.0}


def read_test_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test runs from JSON lines, one test a line; blank lines hold none, lines that are no JSON object are dropped.

    A line holds product_id, title, price, features, user_query and agent_reply, and more if there is
    more. `test_id` is the number of the test in its file, from 1, unless the line has one. Whether a
    field is there is taken from the line's keys: an absent one counts as 0 or empty.
    """
    types = {f.name: f.dataType for f in spark.createDataFrame([], schemas.TEST_CASE).schema}
    lines = read_numbered_lines(spark, path).withColumns({
        "row": F.from_json("line", schemas.TEST_CASE), "keys": F.map_keys(F.from_json("line", "map<string,string>"))
    }).where("keys IS NOT NULL")

    def field(name: str) -> Column:
        value, there = F.col(f"row.{name}"), F.array_contains("keys", name)
        if name == "test_id":
            return F.coalesce(value, F.col("line_no"))
        if name == "features":
            return F.when(there, value).otherwise(F.array().cast(types[name]))
        return F.when(there, value).otherwise(F.lit(_ABSENT[name]).cast(types[name])) if name in _ABSENT else value

    return lines.select(*[field(name).alias(name) for name in types])
