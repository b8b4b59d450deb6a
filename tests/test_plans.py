"""Plans: what is read, what is shuffled, what is broadcast."""

import pathlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from aislekit import schemas
from aislekit.functions.constraints import satisfying
from aislekit.operators import chat, contexts as C, replies, retrieval, sampling
from aislekit.plans import tasks
from aislekit.session import written
from aislekit.sources import vectors
from checks import base as B
from checks.all import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, small):
    return written(B.contexts(spark, small), "contexts")


@pytest.mark.parametrize("kind", ["pick_one", "pick_list", "reject", "clarify"])
def test_generators_shuffle_nothing(stored, kind):
    plan = plan_of(getattr(tasks, kind)(stored, 1))
    assert "Exchange" not in plan and "Join" not in plan and "Sort" not in plan


def test_generators_do_not_repeat_their_fold(stored):
    plan = tasks.pick_list(stored, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and len(plan) < 40_000


def test_context_statistics_shuffle_nothing(stored):
    for df in (C.feature_freq(stored), C.absent_pairs(stored), C.diversity(stored), C.repeat_brands(stored), C.range_points(stored)):
        assert "Exchange" not in plan_of(df)


def test_drawing_is_dealt_to_all_tasks(spark, tmp_path):
    """All requests lie in one file that cannot be split, and look small to the planner."""
    spark.range(5000).selectExpr("id AS ctx_id").coalesce(1).write.parquet(str(tmp_path / "requests"))
    rows = [(f"p{i}", "A", f"s{i % 3}", "t", 1.0, "b", ["x"], 4.0) for i in range(60)]
    library = written(spark.createDataFrame(rows, schemas.PRODUCT), "library")
    requests = spark.read.parquet(str(tmp_path / "requests"))
    drawn = C.draw_contexts(requests, library, 1)
    assert drawn.groupBy(F.spark_partition_id()).count().count() == 8
    assert C.build_contexts(requests, library, 1).count() == 5000


def test_products_are_parsed_in_all_tasks(spark, small, monkeypatch):
    seen = []
    monkeypatch.setattr(B, "written", lambda df, name: seen.append(df) or written(df, name))
    B.contexts(spark, small)
    assert seen[0].rdd.getNumPartitions() == 8


def test_a_constraint_is_computed_once_a_row(spark):
    """Not once more for each product, inside the lambda."""
    made = spark.range(1).withColumn("cons", F.struct(F.md5(F.col("id").cast("string")).alias("brand"), F.lit(None).cast("double").alias("max_price"),
                                                      F.array(F.sha1(F.col("id").cast("string"))).alias("features"), F.lit(None).cast("double").alias("min_rating")))
    made = made.withColumn("products", F.array(F.lit(None).cast(schemas.CONTEXT_PRODUCT)))
    plan = made.select(satisfying(F.col("products"), F.col("cons")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and plan.count("sha1(") + plan.count("sha(") == 1


def test_only_needed_columns_are_read(spark, small):
    library = written(B.library(spark, small), "library")
    plan = plan_of(C.draw_contexts(C.context_requests(spark, 10), library, 1))
    assert "ReadSchema: struct<category:string,sub_category:string>" in plan and "title" not in plan
    plan = plan_of(library.where(F.col("category") == "Home_and_Kitchen").select("product_id"))
    assert "PushedFilters: [IsNotNull(category), EqualTo(category,Home_and_Kitchen)]" in plan
    assert "ReadSchema: struct<product_id:string,category:string>" in plan


def test_contexts_move_only_wanted_products(spark, small):
    library = written(B.library(spark, small), "library")
    plan = plan_of(C.number_products(library))
    assert "ReadSchema: struct<product_id:string,category:string,sub_category:string>" in plan and "title" not in plan
    requests = C.context_requests(spark, 10)
    plan = plan_of(C.draw_contexts(requests, library, 1)).split("Subqueries")[0]
    assert "Join" not in plan.split("Subquery")[0] and "category_no" not in plan
    plan = plan_of(C.build_contexts(requests, library, 1))
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "title" in line)
    join = max(i for i, line in enumerate(lines[:scan]) if "BroadcastHashJoin" in line and "LeftSemi" in line)
    assert not any("Exchange" in line for line in lines[join:scan])


def test_policy_join_broadcasts_the_policies(spark, small):
    plan = plan_of(replies.policy_lookup(B.shopper_queries(spark, small), *B.policies(spark, small)))
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_search_ranks_before_the_last_shuffle(spark, small):
    rows = B.table(spark, small, "embeddings")
    plan = plan_of(retrieval.search(
        rows.select(F.col("vec_id").alias("query_id"), "embedding"), rows.select(F.col("vec_id").alias("product_id"), "embedding")
    ))
    assert "WindowGroupLimit" in plan and "Broadcast" not in plan and "Join" not in plan and "CartesianProduct" not in plan
    # queries and vectors meet by shelf: two shuffles below that, and one of ranked rows above it
    meeting = plan.index("FlatMapCoGroupsInArrow")
    assert plan.count("Exchange") == 3 and plan[:meeting].count("Exchange") == 1 and "MapInArrow" in plan[meeting:]


def test_a_store_is_read_by_cell(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP_BYTES", 8192)
    path = str(tmp_path / "store")
    vectors.write_vectors(B.table(spark, small, "embeddings").withColumnRenamed("vec_id", "product_id"), path)
    store = vectors.open_vectors(spark, path)
    cells = sorted(store.cells.table)
    assert len(cells) > 3 and sum(n for _, _, n in store.cells.table.values()) == store.rows.count()
    some = store.of_cells(cells[:2])
    assert f"PushedFilters: [In(cell, [{cells[0]},{cells[1]}])]" in plan_of(some)
    files = [f for f in pathlib.Path(path, "vectors").glob("*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    ranges = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        column = meta.schema.names.index("cell")
        ranges += [meta.row_group(i).column(column).statistics for i in range(meta.num_row_groups)]
    # what row groups say of their cells leaves out most of them
    assert len(ranges) > 2 and sum(s.min <= cells[0] <= s.max for s in ranges) * 2 <= len(ranges)
    assert {r["cell"] for r in some.select("cell").distinct().collect()} == set(cells[:2])


def test_head_is_a_top_n(spark, small):
    assert "TakeOrderedAndProject" in plan_of(sampling.head_n(B.table(spark, small, "events"), 5, "event_id"))


def test_validation_is_one_pass(spark, small):
    lines = B.table(spark, small, "documents").selectExpr("doc_id AS line_no", "text AS line")
    assert "Exchange" not in plan_of(chat.validate_chat(lines))


def test_products_stay_in_compiled_scan(spark, small):
    plan = plan_of(QUERIES["category_membership"](spark, small))
    assert "Exchange" not in plan and "Join" not in plan
