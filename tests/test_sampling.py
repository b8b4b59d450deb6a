"""Samples: exact sizes, also with copies, and the same rows however the table is cut."""

import hashlib

import pytest
from pyspark.sql import functions as F

from aislekit import vocabulary as V
from aislekit.operators import sampling as S


def lowest(keys, n, seed, salt):
    return set(sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{salt}:{k}".encode()).hexdigest(), k))[:n])


@pytest.mark.parametrize("n", [0, 1, 7, 999, 1000, 5000])
def test_sample_has_exactly_n_rows(spark, n):
    df = spark.range(1000)
    got = [r.id for r in S.sample_n(df, n, 3, "id").collect()]
    assert len(got) == len(set(got)) == min(n, 1000)
    assert set(got) == lowest(range(1000), n, 3, "sample")


def test_sample_does_not_depend_on_partitions(spark):
    a = {r.id for r in S.sample_n(spark.range(0, 5000, 1, 2), 200, 1, "id").collect()}
    b = {r.id for r in S.sample_n(spark.range(0, 5000, 1, 2).repartition(17), 200, 1, "id").collect()}
    assert a == b
    assert a != {r.id for r in S.sample_n(spark.range(5000), 200, 2, "id").collect()}


def test_copies_of_one_row_cannot_swell_a_sample(spark):
    """A third of all rows share one key."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"))
    for n in (1, 500, 1500, 2999):
        for seed in range(3):
            assert S.sample_n(df, n, seed, "key").count() == n


def test_reservoir_skips_blank_lines(spark):
    df = spark.createDataFrame([(1, "a"), (2, "  "), (3, ""), (4, " \t"), (5, "b"), (6, "c")], "k int, line string")
    assert {r.line for r in S.reservoir_sample(df, 10, 1, "k").collect()} == {"a", "b", "c"}
    assert S.reservoir_sample(df, 2, 1, "k").count() == 2


def test_quota_per_category(spark):
    """One category holds most rows, one has fewer than its quota, one is no target."""
    home, food, art = V.TARGET_CATEGORIES[:3]
    name = F.when(F.col("id") < 700, home).when(F.col("id") < 705, food).when(F.col("id") < 800, art).otherwise("Books")
    df = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("product_id"), name.alias("category"))
    got = S.quota_sample(df, 5 * 40 + 3, 9)
    counts = {r.category: r["count"] for r in got.groupBy("category").count().collect()}
    assert counts == {home: 40, food: 5, art: 40}
    ids = {r.product_id for r in got.where(F.col("category") == home).collect()}
    assert ids == lowest([f"p{i}" for i in range(700)], 40, 9, "quota")
    assert S.quota_sample(df, 4, 9).count() == 0


def test_quota_with_copies(spark):
    home = V.TARGET_CATEGORIES[0]
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.concat(F.lit("p"), "id")).alias("product_id"),
        F.lit(home).alias("category"),
    )
    for seed in range(4):
        assert S.quota_sample(df, 5 * 200, seed).count() == 200


@pytest.mark.parametrize("rows,share,size", [(1000, 0.1, 100), (1001, 0.1, 101), (5, 0.1, 1), (10, 0.0, 0), (10, 1.0, 10)])
def test_split_sizes(spark, rows, share, size):
    split = S.train_eval_split(spark.range(rows), share, 42, "id")
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts.get("eval", 0) == size and sum(counts.values()) == rows


def test_split_keeps_copies_together(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"))
    split = S.train_eval_split(df, 0.1, 42, "key", together=True)
    assert split.count() == 3000
    assert split.groupBy("key").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_split_is_exact_under_repeated_keys(spark, seed):
    """900 of 1,000 rows share a key; a third of the rows are equal in all columns."""
    df = spark.range(1000).select(
        F.when(F.col("id") < 900, -1).otherwise(F.col("id")).alias("key"), F.when(F.col("id") < 333, 0).otherwise(F.col("id")).alias("other"))
    split = S.train_eval_split(df, 0.1, seed, "key")
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"eval": 100, "train": 900}
    assert split.drop("split").exceptAll(df).count() == 0 and df.exceptAll(split.drop("split")).count() == 0


def same_rows(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("tie", [["a", "b"], None])
def test_rows_that_tie_are_kept_as_they_are(spark, tie):
    """One key; ties that meet by nulls, rows that differ in other columns or in microseconds only, and equal rows."""
    df = spark.range(0, 600, 1, 4).select(
        F.lit(1).alias("key"), F.when(F.col("id") % 2 == 0, "x").alias("a"), F.when(F.col("id") % 2 == 1, "x").alias("b"),
        F.timestamp_micros(F.when(F.col("id") < 200, 7).otherwise(F.col("id"))).alias("at"))
    split = S.train_eval_split(df, 0.37, 5, "key", tie=tie)
    assert split.where("split = 'eval'").count() == 222
    assert same_rows(split.drop("split"), df)
    if tie is None:
        assert same_rows(S.sample_n(df, 222, 5, "key"), S.sample_n(df.repartition(9), 222, 5, "key"))
        assert df.exceptAll(S.sample_n(df, 222, 5, "key")).count() == 378


def test_equal_rows_are_numbered_in_place(spark):
    """All rows are equal: every sample takes written rows, none is unfolded from a list of numbers."""
    df = spark.range(0, 900, 1, 7).select(F.lit("same").alias("key"), F.lit(None).cast("string").alias("other"))
    for n in (1, 128, 129, 500, 899):
        got = S.sample_n(df, n, 2, "key")
        assert got.count() == n and "explode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_large_buckets_are_looked_into_again(spark, monkeypatch):
    df = spark.range(5000)
    expected = sorted(r.id for r in S.sample_n(df, 777, 3, "id").collect())
    monkeypatch.setattr(S, "_BUCKET_DIGITS", 1)
    monkeypatch.setattr(S, "_RANKED", 3)
    assert sorted(r.id for r in S.sample_n(df, 777, 3, "id").collect()) == expected


def test_sample_filters_without_shuffling_the_rows(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    plan = S.sample_n(df, 50, 1, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_head(spark):
    df = spark.range(0, 50).repartition(5)
    assert [r.id for r in S.head_n(df, 3, "id").collect()] == [0, 1, 2]
    assert S.head_n(df, 0, "id").count() == S.head_n(df, None, "id").count() == 50


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2)])
def test_quotas_merge_in_any_order(spark, order):
    """A category that is full from the start, one that never is, and copies of one key at the cut."""
    home, food, art = V.TARGET_CATEGORIES[:3]
    name = F.when(F.col("id") < 700, home).when(F.col("id") < 705, food).when(F.col("id") < 800, art).otherwise("Books")
    key = F.when((F.col("id") % 5 == 0) & (F.col("id") < 700), "same").otherwise(F.concat(F.lit("p"), F.col("id").cast("string")))
    df = spark.range(1000).select(key.alias("product_id"), name.alias("category"), F.floor(F.col("id") / 10).alias("v"), (F.col("id") * 7 % 4).alias("part"))
    whole = sorted(tuple(r) for r in S.quota_sample(df, 5 * 60, 9).collect())
    kept = df.limit(0)
    for part in order:
        kept = spark.createDataFrame(S.merge_quota(kept, df.where(F.col("part") == part), 5 * 60, 9).collect(), df.schema)
    assert sorted(tuple(r) for r in kept.collect()) == whole


def test_rows_without_a_chance_are_dropped_where_they_are_read(spark):
    home = V.TARGET_CATEGORIES[0]
    df = spark.range(5000).select(F.concat(F.lit("p"), "id").alias("product_id"), F.lit(home).alias("category"))
    kept = S.quota_sample(df.where("product_id < 'p3'"), 5 * 20, 9)
    merged = S.merge_quota(kept, df.where("product_id >= 'p3'"), 5 * 20, 9)
    assert sorted(r.product_id for r in merged.collect()) == sorted(r.product_id for r in S.quota_sample(df, 5 * 20, 9).collect())
    assert S.merge_quota(kept, df, 3, 9).count() == 0
