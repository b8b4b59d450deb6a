"""Samples, splits and heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit.operators import chat, sampling
from aislekit.session import fresh_path
from aislekit.sources import jsonl
from checks import base as B
from checks.base import check


@check("sample_orders", f"""
SELECT o_orderkey, o_custkey FROM orders ORDER BY {B.digest('sample', 'o_orderkey')}, o_orderkey LIMIT 700""")
def sample_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_n(B.table(spark, sf_dir, "orders"), 700, B.SEED, "o_orderkey").select("o_orderkey", "o_custkey")


@check("reservoir_documents", f"""
SELECT doc_id, text AS line FROM documents WHERE length(trim(text)) > 0
ORDER BY {B.digest('sample', 'doc_id')}, doc_id LIMIT 120""")
def reservoir_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("line"))
    return sampling.reservoir_sample(lines, 120, B.SEED, "doc_id")


@check("train_eval_split", f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
  CASE WHEN row_number() OVER (ORDER BY {B.digest('split', 'l_orderkey', 'l_linenumber', 'l_partkey')},
    l_orderkey, l_linenumber, l_partkey)
  <= ceil(0.1 * count(*) OVER ()) THEN 'eval' ELSE 'train' END AS split FROM lineitem""")
def train_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem")
    split = sampling.train_eval_split(rows, 0.1, B.SEED, ["l_orderkey", "l_linenumber", "l_partkey"])
    return split.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "split")


@check("split_repeated_keys", f"""
SELECT event_id, event_type, CASE WHEN row_number() OVER (ORDER BY {B.digest('split', 'event_type')}, {B.digest('copies', 'event_id')})
  <= ceil(0.1 * count(*) OVER ()) THEN 'eval' ELSE 'train' END AS split FROM events""")
def split_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of few values; exactly a tenth is eval nevertheless."""
    rows = B.table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.train_eval_split(rows, 0.1, B.SEED, "event_type", tie=["event_id"])


@check("head_events", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100")
def head_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.head_n(B.table(spark, sf_dir, "events"), 100, "event_id").select("event_id", "event_type")


_NUMBERED_SQL = """SELECT conv_id % 16 AS part, conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN '' WHEN (conv_id + turn) % 11 = 0 THEN '  '
  ELSE concat(CAST(conv_id AS STRING), ' ', CAST(turn AS STRING)) END AS line FROM {conversations}"""


def _line_files(spark: SparkSession, sf_dir: str) -> str:
    """The conversations as 16 text files with blank lines, each in order."""
    path = fresh_path(spark, "lines")
    rows = B._run(spark, _NUMBERED_SQL, conversations=B.table(spark, sf_dir, "conversations"))
    ordered = rows.repartition("part").sortWithinPartitions("part", "conv_id", "turn")
    ordered.select("part", F.col("line").alias("value")).write.partitionBy("part").text(path)
    return path


@check("numbered_lines", f"""SELECT part, line, line_no FROM (SELECT part, line, row_number() OVER (PARTITION BY part ORDER BY conv_id, turn) AS line_no
  FROM ({_NUMBERED_SQL.replace('{conversations}', 'conversations')})) WHERE length(trim(line)) > 0""")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint")
    return jsonl.read_numbered_lines(spark, _line_files(spark, sf_dir)).select(part.alias("part"), "line", "line_no")


@check("merged_lines", f"""SELECT line, count(*) AS n_lines, (SELECT count(*) + (SELECT count(*) FROM conversations) FROM benchmark) AS all_lines, 'match' AS verdict
  FROM (SELECT line FROM ({_NUMBERED_SQL.replace('{conversations}', 'conversations')}) UNION ALL SELECT concat('item ', item_id) FROM benchmark)
  GROUP BY line""")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of lines merged, written and read back; blank lines are lines like others."""
    items, out = fresh_path(spark, "items"), fresh_path(spark, "merged")
    B.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), F.col("item_id")).alias("value")).write.text(items)
    parts = [jsonl.read_lines(spark, path, blank=True) for path in (_line_files(spark, sf_dir), items)]
    chat.merge_sets(one=parts[0], two=parts[1]).select("line").write.text(out)
    back = jsonl.read_lines(spark, out, blank=True)
    told = chat.reconcile(back, *parts)
    counts = back.groupBy("line").agg(F.count(F.lit(1)).alias("n_lines"))
    return counts.select("line", "n_lines", told.select("merged_rows").scalar().alias("all_lines"), told.select("verdict").scalar().alias("verdict"))


_MERGED_SQL = """SELECT doc_id AS row_id, text, 'documents' AS source FROM documents
UNION ALL SELECT conv_id * 100000 + turn, text, 'conversations' FROM conversations
UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark"""


def _parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def part(name: str, key: str) -> DataFrame:
        return B.table(spark, sf_dir, name).selectExpr(f"{key} AS row_id", "text")

    return {
        "documents": part("documents", "doc_id"),
        "conversations": part("conversations", "conv_id * 100000 + turn"),
        "benchmark": part("benchmark", "item_id"),
    }


@check("merged_sets", _MERGED_SQL)
def merged_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.merge_sets(**_parts(spark, sf_dir))


@check("source_counts", f"SELECT source, count(*) AS n_rows FROM ({_MERGED_SQL}) GROUP BY source")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.source_counts(chat.merge_sets(**_parts(spark, sf_dir)))


@check("reconciled_counts", f"""
SELECT part_rows, merged_rows, CASE WHEN part_rows = merged_rows THEN 'match' ELSE 'mismatch' END AS verdict
FROM (SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations)
  + (SELECT count(*) FROM benchmark) AS part_rows, (SELECT count(*) FROM ({_MERGED_SQL})) AS merged_rows)""")
def reconciled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return chat.reconcile(chat.merge_sets(**parts), *parts.values())


_SPOILED_SQL = f"""SELECT row_id, text, source FROM ({_MERGED_SQL}) WHERE NOT (source = 'benchmark' AND row_id = 3) AND NOT (source = 'conversations' AND row_id % 100000 = 5)
UNION ALL SELECT row_id, text, source FROM ({_MERGED_SQL}) WHERE source = 'benchmark' AND row_id = 4
UNION ALL SELECT 0, 'of no part', 'elsewhere'"""


@check("reconciled_contents", f"""WITH p AS ({_MERGED_SQL}), m AS ({_SPOILED_SQL}),
gone AS (SELECT source, count(*) AS n FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM m) GROUP BY source),
n AS (SELECT source, count(*) FILTER (side = 1) AS part_rows, count(*) FILTER (side = 2) AS merged_rows FROM (
  SELECT source, 1 AS side FROM p UNION ALL SELECT source, 2 FROM m) GROUP BY source)
SELECT source, part_rows, merged_rows, CASE WHEN part_rows > merged_rows THEN 'lost' WHEN part_rows < merged_rows THEN 'added'
  WHEN gone.n IS NULL THEN 'match' ELSE 'changed' END AS verdict FROM n LEFT JOIN gone USING (source)""")
def reconciled_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part whole, one with a row lost and another doubled, one with rows lost, and rows of no part."""
    parts = _parts(spark, sf_dir)
    merged = B._run(spark, _SPOILED_SQL.replace(_MERGED_SQL, "SELECT * FROM {merged}"), merged=chat.merge_sets(**parts))
    return chat.reconcile_contents(merged, **parts)
