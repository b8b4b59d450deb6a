"""Line files: rejected lines, capped scans, sources that break, and reservoirs over them."""

import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation, functions as F

from aislekit.operators import sampling as S
from aislekit.sources import jsonl

SCHEMA = "id bigint, name string"
GOOD, BAD = ['{"id":1,"name":"a"}', '{"id":"x","name":"b"}', '{"other":1}'], ['{"id":2', "[1]", "null", "3"]


def lines_file(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_a_broken_line_stops_the_job(spark, tmp_path):
    path = lines_file(tmp_path / "good", [GOOD[0], "", "  ", *GOOD[1:]])
    assert {tuple(r) for r in jsonl.read_jsonl(spark, path, SCHEMA).collect()} == {(None, None), (None, "b"), (1, "a")}
    for bad in BAD:
        path = lines_file(tmp_path / f"bad{BAD.index(bad)}", [*GOOD, bad])
        with pytest.raises(PySparkException, match="no JSON object"):
            jsonl.read_jsonl(spark, path, SCHEMA).collect()
        with pytest.raises(PySparkException):
            jsonl.read_jsonl(spark, path, SCHEMA).count()


def test_rejected_lines_are_counted_and_listed(spark, tmp_path):
    path = lines_file(tmp_path / "mixed", [GOOD[0], BAD[0], "", *GOOD[1:], *BAD[1:]])
    counts = Observation("scan")
    rows = jsonl.read_jsonl(spark, path, SCHEMA, strict=False, counts=counts).collect()
    assert {tuple(r) for r in rows} == {(1, "a"), (None, "b"), (None, None)}
    assert counts.get == {"lines": 7, "rejected": 4}
    found = jsonl.rejected_lines(spark, path, SCHEMA).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in found] == [(2, BAD[0]), (6, BAD[1]), (7, BAD[2]), (8, BAD[3])]
    assert all(r.file.endswith("/mixed") for r in found)


def meta(i):
    return json.dumps({"parent_asin": f"p{i:04d}", "title": "t" * (i % 50)})


@pytest.mark.parametrize("cap", [0, 1, 7, 80, 150, 1000])
def test_the_cap_keeps_the_first_readable_lines(spark, tmp_path, cap):
    """Two files of several blocks each, with blank and broken lines."""
    folder = tmp_path / "raw"
    folder.mkdir()
    for part in (0, 1):
        rows = [x for i in range(part * 100, part * 100 + 100) for x in ([meta(i), "{bad"] if i % 3 else ["", meta(i)])]
        lines_file(folder / f"part{part}.jsonl", rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        found = jsonl.read_raw_meta(spark, [str(folder)], cap)
        assert sorted(r.parent_asin for r in found.collect()) == [f"p{i:04d}" for i in range(min(cap, 200))]
        assert (cap == 0 or found.rdd.getNumPartitions() > 4) and "GlobalLimit" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_source_that_breaks_gives_way_to_the_next(spark, tmp_path):
    whole = gzip.compress("\n".join(meta(i) for i in range(3000)).encode())
    (tmp_path / "cut.jsonl.gz").write_bytes(whole[:len(whole) // 2])
    (tmp_path / "other.jsonl.gz").write_bytes(gzip.compress("\n".join(meta(i) for i in range(5)).encode()))
    paths = [str(tmp_path / name) for name in ("absent", "cut.jsonl.gz", "other.jsonl.gz")]
    assert jsonl.read_raw_meta(spark, paths).count() == 5
    assert jsonl.read_raw_meta(spark, paths, 3).count() == 3
    with pytest.raises(FileNotFoundError):
        jsonl.read_raw_meta(spark, paths[:2])


def test_columns_of_any_name_stay(spark):
    df = spark.range(300).select("id", (F.col("id") % 2 == 0).alias("chosen"), F.lit("x").alias("Copy"), (F.col("id") % 7).alias("k"), F.lit("line").alias("drawn"),
                                 F.lit("Home_and_Kitchen").alias("category"), F.lit(1).alias("copies"))
    for key in ("id", "k"):
        for out in (S.sample_n(df, 50, 1, key), S.quota_sample(df, 250, 1, key), S.reservoir_sample(df, 50, 1, key, "drawn")):
            assert out.columns == df.columns and out.count() == 50
            assert all(r.chosen == (r.id % 2 == 0) for r in out.collect())
        split = S.train_eval_split(df, 0.1, 1, key)
        assert split.columns == [*df.columns, "split"] and split.where("split = 'eval'").count() == 30


def test_equal_rows_under_a_clashing_name(spark):
    df = spark.range(60).select(F.lit(1).alias("k"), F.lit(True).alias("chosen"), F.lit("c").alias("copy"))
    assert S.sample_n(df, 11, 1, "k").count() == 11 and S.sample_n(df, 11, 1, "k").columns == df.columns
    assert S.reservoir_sample(df, 11, 1, "k", "copy").count() == 11


def test_reservoirs_are_merged_in_one_pass(spark):
    df = spark.range(0, 200_000, 1, 40).select("id", F.concat(F.lit("line "), F.col("id")).alias("line"))
    found = S.reservoir_sample(df, 20_000, 5, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("MapInArrow") == 4 and "Sort" not in plan and "Window" not in plan
    assert {r.id for r in found.collect()} == {r.id for r in S.sample_n(df, 20_000, 5, "id").collect()}


def test_reservoir_takes_the_rows_that_a_sample_takes(spark):
    df = spark.range(0, 3000, 1, 5).select((F.col("id") % 100).alias("k"), (F.col("id") % 1000).alias("v"), F.lit("x").alias("line"))
    for n in (1, 29, 31, 500, 2999, 3000, 4000):
        a = sorted(tuple(r) for r in S.sample_n(df, n, 2, "k").collect())
        assert a == sorted(tuple(r) for r in S.reservoir_sample(df, n, 2, "k").collect()) and len(a) == min(n, 3000)
