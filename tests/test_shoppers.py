"""Shopper questions to answers."""

from aislekit import schemas, vocabulary as V
from aislekit.plans import jobs


def test_answers_with_and_without_hits(spark):
    queries = spark.createDataFrame(
        [(1, 1, "any pan?", [1.0, 0.0]), (2, 2, "any pot?", [0.0, 1.0]), (3, 3, "how long does delivery take?", [1.0, 0.0])],
        "query_id int, conv_id int, user_query string, embedding array<float>",
    )
    vectors = spark.createDataFrame([("p1", [1.0, 0.0])], "product_id string, embedding array<float>")
    products = spark.createDataFrame([("p1", "c", "s", "Pan", 5.0, "B", ["x"], None)], schemas.PRODUCT)
    history = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id int, turn int, role string, text string")
    shipping = spark.createDataFrame([], schemas.SHIPPING)
    returns = spark.createDataFrame([], schemas.RETURNS)
    got = {r.query_id: r for r in jobs.answer_shoppers(
        queries, vectors, products, history, shipping, returns, "sys", threshold=0.5
    ).collect()}
    listed = '[{"product_id":"p1","category":"c","title":"Pan","price":5.0,"brand":"B","features":["x"],"avg_rating":null}]'
    assert got[1].route == got[2].route == "search"
    assert got[1].prompt == (
        "<|system|>\nsys\n<|user|>\nhi\n<|user|>\nany pan?\n\n"
        f"{V.CONTEXT_INTRO}\n{V.PRODUCTS_PREFIX}{listed}\n<|assistant|>\n"
    )
    assert got[2].prompt == f"<|system|>\nsys\n<|user|>\nany pot?\n\n{V.NO_MATCH_INTRO}\n<|assistant|>\n"
    assert got[3].route == "shipping" and got[3].prompt is None
    assert got[3].policy_text == "Shipping information not available for Home_and_Kitchen."


def test_lists_hold_k_products_though_vectors_lack_theirs(spark):
    """Nearer vectors without a product take no place in the list."""
    queries = spark.createDataFrame([(1, 1, "any pan?", [1.0, 0.0])], "query_id int, conv_id int, user_query string, embedding array<float>")
    vectors = spark.createDataFrame([(f"p{i:02d}", [1.0, i / 100]) for i in range(30)], "product_id string, embedding array<float>")
    products = spark.createDataFrame(
        [(f"p{i:02d}", "c", "s", f"Pan {i}", 5.0, "B", ["x"], None) for i in range(10, 30)], schemas.PRODUCT)
    history = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    none = spark.createDataFrame([], schemas.SHIPPING), spark.createDataFrame([], schemas.RETURNS)
    prompt, = jobs.answer_shoppers(queries, vectors, products, history, *none, "sys").collect()
    assert [prompt.prompt.count(f'"p{i}"') for i in range(10, 20)] == [1] * 8 + [0] * 2
