"""JSON-lines tables and the one-document metrics file."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from aislekit import schemas
from aislekit.functions.text import is_blank
from aislekit.session import written

_BROKEN = "_corrupt_record"


def _is_object(line: Column) -> Column:
    """Whether a text is a JSON object; keys may repeat and numbers may be NaN."""
    return (F.substring(F.ltrim(line), 1, 1) == "{") & F.from_json(line, "map<string,string>").isNotNull()


def _parsed(lines: DataFrame, schema: str | StructType) -> DataFrame:
    """The lines with `row`, their fields, and `broken`: a line that is no JSON object.

    A value of another type than its field's is null and breaks nothing. What follows the object on its line is not read.
    """
    if not isinstance(schema, str):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    fields = F.from_json(F.col("line"), f"{schema}, {_BROKEN} string", {"columnNameOfCorruptRecord": _BROKEN})
    parsed = lines.withColumn("row", fields)
    # only lines that do not fit the schema are looked at again
    misfit = F.col("row").isNull() | F.col(f"row.{_BROKEN}").isNotNull()
    return parsed.withColumn("broken", F.when(misfit, ~_is_object(F.col("line"))).otherwise(F.lit(False)))


def _fields(parsed: DataFrame) -> DataFrame:
    names = [n for n in parsed.schema["row"].dataType.names if n != _BROKEN]
    return parsed.select(*[F.col("row").getField(n).alias(n) for n in names])


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType, strict: bool = True, counts: Observation | None = None) -> DataFrame:
    """Rows of JSON-lines files; blank lines hold no row.

    A line that is no JSON object stops the job and is named in the error; without `strict` it is passed over, and
    `rejected_lines` lists it. `counts` observes `lines` and `rejected` in the pass that reads the rows.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    parsed = _parsed(lines.where(~is_blank(F.col("line"))), schema)
    if counts is not None:
        parsed = parsed.observe(counts, F.count(F.lit(1)).alias("lines"), F.count_if("broken").alias("rejected"))
    if strict:
        told = F.concat(F.lit("no JSON object in "), F.col("file"), F.lit(": "), F.substring("line", 1, 200))
        parsed = parsed.where(~F.when(F.col("broken"), F.raise_error(told).cast("boolean")).otherwise(F.lit(False)))
    else:
        parsed = parsed.where(~F.col("broken"))
    return _fields(parsed)


def rejected_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(file, line_no, line) of the lines that are no JSON objects."""
    return _parsed(read_numbered_lines(spark, path), schema).where("broken").select("file", "line_no", "line")


def _numbered_from_zero(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, block, place, line): the readable lines; in a block of a file their places are consecutive.

    A block is read by one task from top to bottom, and ids count the rows that the filter leaves in that order.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    readable = _parsed(lines.where(~is_blank(F.col("line"))), schema).where(F.col("row").isNotNull() & F.col(f"row.{_BROKEN}").isNull())
    return readable.select("file", "block", F.monotonically_increasing_id().alias("place"), "line")


def _blocks(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """(file, block, first, n, before): readable lines of each block and of all blocks before; None if the source cannot
    be read to its end. Files come in the order of their names. One row a file block goes through the running count."""
    try:
        found = _numbered_from_zero(spark, path, schema).groupBy("file", "block").agg(
            F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return written(found.withColumn("before", before), "blocks")
    except (PySparkException, Py4JJavaError):  # absent, cut short, or not what its name says
        return None


def read_raw_meta(
    spark: SparkSession, paths: list[str], max_rows: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Raw metadata from the first source that can be read to its end; lines that are no JSON are dropped.

    A first pass reads through a source and counts its lines by file block; a source that breaks on the way, as a cut
    gzip file does, counts for nothing, and the next one is tried. `max_rows` (`vocabulary.RAW_ROW_CAP` is the usual
    cap) keeps exactly the first lines: blocks are kept, dropped or cut where they are read, by the counts. A gzip file
    is one task, so `partitions` can spread its rows before the work that follows.
    """
    for path in paths:
        blocks = _blocks(spark, path, schemas.RAW_META)
        if blocks is not None:
            break
    else:
        raise FileNotFoundError(f"no readable source among {paths}")
    lines = _numbered_from_zero(spark, path, schemas.RAW_META)
    if max_rows is not None:
        kept = blocks.where(F.col("before") < max_rows).select("file", "block", "first", (F.lit(max_rows) - F.col("before")).alias("room"))
        lines = lines.join(kept, ["file", "block"]).where(F.col("place") - F.col("first") < F.col("room"))
    rows = _fields(_parsed(lines.select("line"), schemas.RAW_META))
    return rows.repartition(partitions) if partitions else rows


def read_lines(spark: SparkSession, path: str | list[str], blank: bool = False) -> DataFrame:
    """Text lines, column `line`; blank ones are skipped unless asked for."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines if blank else lines.where(~is_blank(F.col("line")))


def read_numbered_lines(spark: SparkSession, path: str | list[str], blank: bool = False) -> DataFrame:
    """(file, line_no, line) with line numbers from 1 in each file; blank lines count but are left out unless asked for.

    A file's block is read by one task from top to bottom, and `monotonically_increasing_id` counts rows in that
    order. So a line's number is its id less the least of its block, plus the lines of the blocks before: the text
    stays where it is read, and only one row per block is joined to it.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    )
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")
    # Written, so that its size is known: Spark sends it to every task if it is small.
    starts = written(blocks.select("file", "block", (before - F.col("first") + 1).alias("shift")), "blocks")
    numbered = lines.join(starts, ["file", "block"])
    numbered = numbered.select("file", (F.col("place") + F.col("shift")).alias("line_no"), "line")
    return numbered if blank else numbered.where(~is_blank(F.col("line")))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, null fields written out."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A one-row table as a single JSON document."""
    df.coalesce(1).write.option("ignoreNullFields", "false").json(path)
