"""Reply clean-up, resolution and scores: edge rows by hand."""

import pytest
from pyspark.sql import functions as F

from aislekit import schemas, vocabulary as V
from aislekit.functions.replies import clean_reply, strip_tool_tags
from aislekit.operators import metrics as M, replies as R

CLEANED = [
    ("STOP", ""), ("| Stop |", ""), ("Fine. STOP", "Fine."), ("a | b", "a b"), ("<|end|>hello", "<>hello"), ("<|start|>hello", "hello"),
    ("Available products: [\n{}\n] Buy it.", "Buy it."), ("It is blue. Would you like more?", "It is blue."),
    ("Nice. What", "Nice."), ("  x  y ", "x y"), (None, ""), ("", ""), ("ok |endtool| go", "ok go"),
    ("I am finished. Bye", "I am . Bye"), ("Done STOP Stop", "Done"), ("Done Stop STOP", "Done"), ("THE END", "THE"),
    ("Please note that shipping times may vary by day. Ok.", "Ok."), ("a\n\n b", "a b"), ("stopping", "stopping"),
    ("I see you provided a list. It helps.", "It helps."), ("two\x1cparts", "two parts"),
]


def test_clean_reply(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEANED)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(clean_reply(F.col("t"))).collect()] == [want for _, want in CLEANED]


def test_tool_tags(spark):
    df = spark.createDataFrame([(" [TOOL: x] a [TOOL:y]",), ("[TOOL",)], "t string")
    assert [r[0] for r in df.select(strip_tool_tags(F.col("t"))).collect()] == ["a", "[TOOL"]


REPLIES = [
    # question, recorded reply, reply after the call, told to a shopper, told in a batch
    ("ship time for health?", "[TOOL: get_shipping_speed]", "Five days. STOP", "Five days.", "Five days."),
    ("ship time for health?", "[TOOL: get_shipping_speed]", None, "SHIP", "SHIP"),
    ("return a tool", "x [TOOL:get_return_policy]", "[TOOL: a]", "RETURN", "RETURN"),
    ("what is it", "[TOOL: get_shipping_speed]", "Five days", V.NO_INFORMATION, "[TOOL: get_shipping_speed]"),
    ("deliver health", "STOP", None, "SHIP", ""),
    ("refund tool", "", None, "RETURN", ""),
    ("hello", None, None, V.NO_INFORMATION, ""),
    ("hello", "Hi. [TOOL: a] Let me know", None, "Hi.", "Hi. [TOOL: a]"),
]
SHIP = "Shipping options:\n- Standard: 5 days (free)\n- Express: 2 days ($7)\n- Overnight: 1 days ($25)"
RETURN = "Return policy:\n- Return window: 30 days\n- Condition: New\n- Restocking fee: $5\n- Special notes: None"


@pytest.fixture(scope="module")
def policies(spark):
    shipping = [(1, "Health_and_Household", "5", "2", "1", "0", "7", "25")]
    returns = [(1, "Tools_and_Home_Improvement", "30 days", "New", "5", None)]
    return spark.createDataFrame(shipping, schemas.SHIPPING), spark.createDataFrame(returns, schemas.RETURNS)


def test_resolved_replies(spark, policies):
    rows = [(i, q, raw, follow, None) for i, (q, raw, follow, _, _) in enumerate(REPLIES)] + [(99, "q", "r", None, "broke")]
    df = spark.createDataFrame(rows, schemas.EDGE_CASE)
    full = {"SHIP": SHIP, "RETURN": RETURN}
    shown = {r.query_id: r.agent_reply for r in R.resolve_reply(df.where("query_id < 99"), *policies).collect()}
    assert shown == {i: full.get(want, want) for i, (*_, want, _) in enumerate(REPLIES)}
    batch = {r.query_id: r.agent_reply for r in R.edge_case_replies(df, *policies).collect()}
    assert batch == {**{i: full.get(want, want) for i, (*_, want) in enumerate(REPLIES)}, 99: "ERROR: broke"}


PRODUCT = dict(title="Cetaphil Vitamins - Personal Care", price=295.26, brand="Cetaphil", features=["Gentle", "Fragrance Free"], avg_rating=3.4)


def run(spark, cases):
    rows = []
    for i, (query, reply, change) in enumerate(cases):
        p = {**PRODUCT, **change}
        rows.append((i, "p", p["title"], p["price"], p["brand"], p["features"], p["avg_rating"], query, reply, 0.5, None))
    results = M.evaluate_runs(spark.createDataFrame(rows, schemas.TEST_CASE))
    return [r for r in results.orderBy("test_id").collect()]


def test_published_sample(spark):
    r = run(spark, [("What is the price of Cetaphil Vitamins?", "The Cetaphil Vitamins - Personal Care costs $295.26.", {})])[0]
    e = r.evaluation
    assert (e.query_type, e.is_helpful, e.is_accurate, e.is_complete, e.is_relevant) == ("price", True, True, True, True)
    assert e.confidence_score == pytest.approx(1.0) and e.strengths == ["Accurate price information"] and e.issues == []


def test_rejections_and_checks(spark):
    cases = [
        ("What is the price?", "It costs $12.00, a good deal", {}),
        ("Any?", "  ", {}),
        ("Any?", "Sorry, no.", {}),
        ("Is it organic?", "Yes, organic.", {}),
        ("Is it blue?", "Yes", {}),
        ("What is the price?", "It costs $12.00, a good deal", {"price": None}),
        ("What is the price?", "No idea at all, really none", {"price": None}),
        ("How is it rated?", "4 stars", {"avg_rating": None}),
        ("Hello", "Short", {"title": None}),
        ("Is it gentle?", "Yes it is", {"features": None}),
        ("How is it rated?", "It has 3.4 stars from buyers", {}),
        ("What brand?", "Brand: Cetaphil made here", {}),
        ("What brand?", "Brand: Cetaphil made here", {"brand": None}),
        ("What brand?", "Brand: Cetaphil made here", {"brand": ""}),
        ("Price?", "$5.00", {"price": 0.0}),
        ("Which price", "12345678.5 dollars in all, the price", {"price": 12345678.5}),
        ("Hello", "123456789", {}),
        ("Hello", "1234567890", {}),
        ("Hello", "12345678901", {}),
    ]
    rows = run(spark, cases)
    e = [r.evaluation for r in rows]
    assert not e[0].is_accurate and e[0].issues == ["Price information present but inaccurate"]
    assert e[1].issues == ["Empty response"] and e[1].is_empty and e[1].confidence_score == 0.0
    assert e[2].issues == ["Contains error"] and not e[2].is_helpful and not e[2].contains_error
    assert e[3].issues == ["Incorrectly claimed organic feature"]
    assert e[4].issues == ["Could not identify specific feature being asked about"] and e[4].is_helpful is False
    for i, why in ((5, "'>' not supported"), (7, "'>' not supported"), (8, "no attribute 'lower'"), (9, "not iterable")):
        assert e[i].error and e[i].query_type is None and rows[i].response_time == 0 and why in rows[i].agent_reply
    assert not e[6].error and e[6].issues == ["No price information found"]
    assert e[10].is_accurate and e[11].is_accurate
    assert e[12].is_helpful and e[13].is_helpful and not e[13].is_accurate
    assert e[14].is_helpful and not e[14].is_accurate
    assert e[15].is_accurate
    assert e[16].issues[0] == "Response too short" and e[17].issues == ["Response doesn't mention the product"]
    assert not e[17].is_helpful and e[18].is_helpful


def test_missing_columns_count_as_nothing(spark):
    df = spark.createDataFrame(
        [(1, "p", "T", 5.0, ["a"], "What brand is it, how is it rated?", "rating: 4.5 stars here", 1.0)],
        "test_id bigint, product_id string, title string, price double, features array<string>, user_query string, agent_reply string, response_time double",
    )
    e = M.evaluate_runs(df).collect()[0].evaluation
    assert e.is_helpful and not e.is_accurate and e.issues == ["Rating information present but no expected rating to compare"]


def test_metrics_of_nothing(spark):
    results = M.evaluate_runs(spark.createDataFrame([], schemas.TEST_CASE))
    assert tuple(M.run_metrics(results).collect()[0]) == (0, 0, 0.0, 0.0, 0.0)
    assert tuple(M.latency_metrics(results).collect()[0]) == (0.0, 0.0)
    assert M.accuracy_by_type(results).count() == 0
    assert M.all_metrics(results).collect()[0].total_tests == 0


def test_metrics(spark):
    rows = [
        (i, "p", "t", 1.0, "b", [], 4.0, q, reply, time, error)
        for i, (q, reply, time, error) in enumerate([
            ("price", "$1.0", 1.0, None), ("price", "$2", 3.0, None), ("hello", " ", 0.0, None), ("hello", "an error", 2.0, None),
            ("hello", "fine", 9.0, "lost"),
        ])
    ]
    results = M.evaluate_runs(spark.createDataFrame(rows, schemas.TEST_CASE))
    total = M.all_metrics(results).collect()[0]
    assert (total.total_tests, total.successful_tests, total.success_rate) == (5, 4, 0.8)
    assert (total.empty_response_rate, total.error_response_rate) == (0.2, 0.2)
    assert total.query_type_accuracy == {"price": 0.5, "general": 0.0, "unknown": 0.0}
    assert total.avg_response_time == 2.0 and total.response_time_compliance == pytest.approx(2 / 3)
