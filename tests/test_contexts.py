"""Contexts: draws, membership, independence of the partitioning, hot groups."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from aislekit import schemas
from aislekit.operators import contexts as C


@pytest.fixture(scope="module")
def library(spark):
    """One sub-category holds most products, one has three, one row has no sub-category."""
    rows = [(f"p{i:05d}", "A", "hot", f"t{i}", float(i), "b", ["x"], 4.0) for i in range(3000)]
    rows += [(f"q{i}", "A", "Few Items", f"t{i}", 1.0, "b", [], 4.0) for i in range(3)]
    rows += [(f"r{i}", "B", "only", f"t{i}", 1.0, "b", None, None) for i in range(20)]
    rows += [("s0", "C", "", "t", 1.0, "b", [], 4.0), ("s1", None, "x", "t", 1.0, "b", [], 4.0)]
    return spark.createDataFrame(rows, schemas.PRODUCT)


def test_numbers_are_dense(spark, library):
    numbered = C.number_products(library)
    for sub, n in (("hot", 3000), ("Few Items", 3), ("only", 20)):
        got = sorted(r.position for r in numbered.where(F.col("sub_category") == sub).collect())
        assert got == list(range(1, n + 1))


def test_numbers_do_not_depend_on_partitions(spark, library):
    a = {(r.product_id, r.position) for r in C.number_products(library).collect()}
    b = {(r.product_id, r.position) for r in C.number_products(library.repartition(11)).collect()}
    assert a == b


def test_copies_count_as_rows(spark):
    """A third of all rows are copies of one product; each is drawn like any other row."""
    rows = [("copy" if i % 3 == 0 else f"p{i}", "A", "s", "t", 1.0, "b", ["x"], 4.0) for i in range(90)]
    library = spark.createDataFrame(rows, schemas.PRODUCT)
    numbered = C.number_products(library).collect()
    assert sorted(r.position for r in numbered) == list(range(1, 91))
    ctx = C.build_contexts(C.context_requests(spark, 900), library, 1).collect()
    assert all(len(r.products) == 8 for r in ctx)
    copies = sum(p.product_id == "copy" for r in ctx for p in r.products)
    assert abs(copies / (900 * 8) - 1 / 3) < 0.03


def test_draws_are_uniform_by_category_then_sub_category(spark, library):
    drawn = C.draw_contexts(C.context_requests(spark, 6000), library, 1)
    counts = Counter((r.category, r.sub_category) for r in drawn.collect())
    assert sum(counts.values()) == 6000
    assert abs(counts["B", "only"] - 3000) < 250
    assert abs(counts["A", "hot"] - 1500) < 200 and abs(counts["A", "Few Items"] - 1500) < 200


def test_members(spark, library):
    ctx = C.build_contexts(C.context_requests(spark, 2000), library, 1)
    rows = ctx.collect()
    assert len(rows) == 2000
    uses = Counter()
    for r in rows:
        ids = [p.product_id for p in r.products]
        assert len(set(ids)) == len(ids) == (3 if r.sub_category == "Few Items" else 8)
        assert {p.category for p in r.products} == {r.sub_category.lower().replace(" ", "_")}
        if r.sub_category == "Few Items":
            assert ids == ["q0", "q1", "q2"]
        if r.sub_category == "only":
            uses.update(ids)
    mean = sum(uses.values()) / 20
    assert len(uses) == 20 and all(abs(n - mean) < 0.25 * mean for n in uses.values())


def test_contexts_do_not_depend_on_partitions(spark, library):
    a = {(r.ctx_id, tuple(p.product_id for p in r.products)) for r in C.build_contexts(C.context_requests(spark, 300), library, 1).collect()}
    b = {(r.ctx_id, tuple(p.product_id for p in r.products))
         for r in C.build_contexts(C.context_requests(spark, 300).repartition(9), library.repartition(3), 1).collect()}
    assert a == b


def test_columns_on_gaps(spark):
    rows = [(1, [("p", "c", "t", None, "", None, None)]), (2, [("p", "c", "t", 5.0, "B", ["a", "a", "b"], 3.0), ("q", "c", "t", 15.0, "B", ["b"], 5.0)])]
    df = spark.createDataFrame(rows, f"ctx_id bigint, products array<{schemas.CONTEXT_PRODUCT}>")
    wide = {r.ctx_id: r for r in C.diversity(df).collect()}
    assert tuple(wide[1])[1:] == ([], 0.0, 0.0, 0.0, 0.0)
    assert tuple(wide[2])[1:] == (["B"], 5.0, 15.0, 3.0, 5.0)
    assert [(r.feature, r.n) for r in C.feature_freq(df).collect()] == [("a", 2), ("b", 2)]
    assert [r.feature for r in C.top_feature(df).orderBy("ctx_id").collect()] == ["", "a"]
    assert [tuple(r) for r in C.cooccurrence(df).collect()] == [(2, "a", "b", 1)]
    assert C.absent_pairs(df).count() == 0
    points = {r.ctx_id: (r.target_price, r.rating_floor) for r in C.range_points(df).collect()}
    assert points[1] == (200.0, None) and points[2][0] == pytest.approx(12.0) and points[2][1] == pytest.approx(3.6)


def test_constraint_table(spark):
    from aislekit.functions.constraints import matches

    product = "struct<price: double, brand: string, features: array<string>, avg_rating: double>"
    cons = "struct<max_price: double, brand: string, features: array<string>, min_rating: double>"
    cases = [
        ((None, "X", ["a"], 4.0), (10.0, None, [], None), True),
        ((9.0, "X", ["a"], None), (None, None, [], 4.0), True),
        ((9.0, None, ["a"], 4.0), (None, "X", [], None), False),
        ((9.0, None, ["a"], 4.0), (None, "", [], None), True),
        ((9.0, "X", ["a", "b"], 4.0), (None, None, ["a"], None), True),
        ((9.0, "X", ["a", "b"], 4.0), (None, None, ["a", "c"], None), False),
        ((9.0, "X", None, 4.0), (None, None, ["a"], None), False),
        ((9.0, "X", None, 4.0), (None, None, None, None), True),
        ((9.0, "X", ["a"], 4.0), (9.0, "X", ["a"], 4.0), True),
        ((9.01, "X", ["a"], 4.0), (9.0, None, [], None), False),
        ((9.0, "X", ["a"], 3.9), (None, None, [], 4.0), False),
    ]
    df = spark.createDataFrame([(p, c, i) for i, (p, c, _) in enumerate(cases)], f"p {product}, c {cons}, i int")
    got = [r[0] for r in df.orderBy("i").select(matches(F.col("p"), F.col("c"))).collect()]
    assert got == [want for _, _, want in cases]
