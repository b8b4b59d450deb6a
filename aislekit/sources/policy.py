"""Policy tables keyed by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit.sources.jsonl import read_numbered_lines


def load_policy(df: DataFrame) -> DataFrame:
    """The last row of each category by `line_no`; rows without a category are dropped.

    max_by keeps one row per category on the map side, so a category with most of the
    rows costs no more than a small one.
    """
    fields = [c for c in df.columns if c not in ("category", "line_no")]
    last = F.max_by(F.struct(*fields), F.col("line_no")).alias("last")
    return (
        df.where(F.length("category") > 0).groupBy("category").agg(last).select("category", "last.*")
    )


def read_policy(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON-lines policy file with their `line_no`; `load_policy` keeps the last ones."""
    row = F.from_json("line", schema).alias("row")
    fields = spark.createDataFrame([], schema).columns
    return read_numbered_lines(spark, path).select("line_no", row).select(
        "line_no", *[F.col(f"row.{name}") for name in fields if name != "line_no"]
    )
