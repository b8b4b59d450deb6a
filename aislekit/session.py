"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning, skew splitting and small-file coalescing. Broadcasts are left
# to Spark's own size check (autoBroadcastJoinThreshold, on measured sizes under AQE).
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "aislekit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; `conf` entries win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in `spark.checkpoint.dir`; a session must have one.

    Intermediate tables are written there. Nothing of the package removes them, since a result may still
    be read from them: whoever runs a job gives it a folder of its own and removes it after the job.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never one that an earlier run used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to as many tasks as a shuffle has, for dear work on rows that a small or unsplittable file holds."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage of `df` by a Parquet table in the shared folder; `options` are those of its writer.

    The table outlives lost executors, so nothing upstream is computed again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
