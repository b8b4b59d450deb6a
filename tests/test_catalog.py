"""Raw metadata and sources: edge rows by hand."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from aislekit import schemas
from aislekit.functions import products as P
from aislekit.operators import catalog as O
from aislekit.sources import jsonl, policy, vectors


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"v {kind}")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_sub_category(spark):
    given = ['[["a","b"],["c"]]', '["a","b"]', "[]", None, "[[]]", '"text"', "{bad", '["a", 5]', '["x", ""]']
    assert values(spark, given, P.sub_category) == ["b", "b", "", "", "[]", "", "", "5", ""]


def test_features(spark):
    given = ['["a","b"]', '"x"', None, "[]", '{"a": 1}', "null", "{bad"]
    assert values(spark, given, P.features_of) == [["a", "b"], [], [], [], [], [], []]


def test_price(spark):
    given = ["12.5", " 7 ", "None", None, "$9", "1.0d", "1e3", "", "NaN", "-4", ".5", "12,5", "1_0"]
    assert values(spark, given, P.price_of) == [12.5, 7.0, None, None, None, None, 1000.0, None, None, -4.0, 0.5, None, None]


def test_brand(spark):
    given = ['{"Brand": "A", "brand": "b"}', '{"brand": "b"}', "{broken", None, "{}", '{"Brand": ""}']
    assert values(spark, given, P.brand_of) == ["A", "b", "", "", "", ""]


def test_target_category(spark):
    given = ["HOME_AND_KITCHEN", "tools", "Books", "Home & Kitchen", None, "Baby_Products"]
    assert values(spark, given, P.target_category) == [
        "Home_and_Kitchen", "Tools_and_Home_Improvement", None, None, None, "Health_and_Household"
    ]


def test_feature_phrase(spark):
    given = [["A"], ["A", "B"], ["A", "B", "C"], [], None]
    phrase = lambda c: P.feature_phrase(c, "is plain")
    assert values(spark, given, phrase, "array<string>") == [
        "features A", "features A and B", "features A, B, and C", "is plain", "is plain"
    ]


@pytest.mark.parametrize("digits", [1, 2])
def test_fixed_rounds_like_the_binary_value(spark, digits):
    given = [2.675, 0.25, 0.125, 4.05, 3.35, 1234567.891, 295.26, 0.0, 4.45]
    got = values(spark, given, lambda c: P.fixed(c, digits), "double")
    assert got == [f"{v:.{digits}f}" for v in given]


def test_item_phrase(spark):
    one = "struct<title: string, brand: string>"
    rows = [
        ([("Pyrex Blender - Kitchen Appliances", "Pyrex")],), ([("Pyrex", "Pyrex")],), ([("Blue  Jug - a - b", "X")],),
        ([("", "X"), (None, None)],), ([],),
    ]
    df = spark.createDataFrame(rows, f"products array<{one}>")
    got = [r[0] for r in df.select(P.item_phrase(F.col("products"), F.md5(F.lit("1")), "product")).collect()]
    assert got == ["blender", "pyrex", "blue  jug", "product", "product"]


def test_raw_scan_takes_the_first_readable_source(spark, tmp_path):
    good = {
        "main_category": "Tools", "categories": [["T", "Drills"]], "features": ["Loud"], "price": 12.5,
        "details": {"Brand": "Bolt"}, "parent_asin": "A1", "title": "Drill", "average_rating": 4.5,
    }
    text_details = {**good, "details": json.dumps({"brand": "Nut"}), "price": "None", "parent_asin": "A2", "categories": ["T", "Saws"]}
    lines = [json.dumps(good), "", "{cut", json.dumps(text_details), json.dumps({**good, "title": ""}), json.dumps({**good, "parent_asin": ""})]
    path = tmp_path / "meta.jsonl.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    raw = jsonl.read_raw_meta(spark, [str(tmp_path / "absent.gz"), str(path), "also-absent"], partitions=3)
    assert raw.count() == 4
    rows = {r.product_id: r for r in O.extract_products(raw).collect()}
    assert set(rows) == {"A1", "A2"}
    assert (rows["A1"].price, rows["A1"].brand, rows["A1"].sub_category, rows["A1"].avg_rating) == (12.5, "Bolt", "Drills", 4.5)
    assert (rows["A2"].price, rows["A2"].brand, rows["A2"].sub_category) == (None, "Nut", "Saws")
    assert jsonl.read_raw_meta(spark, [str(path)], max_rows=2).count() == 2
    with pytest.raises(FileNotFoundError):
        jsonl.read_raw_meta(spark, [str(tmp_path / "absent.gz")])


def test_jsonl_keeps_nulls_and_letters(spark, tmp_path):
    df = spark.createDataFrame([("p", "c", "s", "Café “x”", None, "b", ["ä"], 4.0)], schemas.PRODUCT)
    path = str(tmp_path / "out")
    jsonl.write_jsonl(df, path)
    line = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))
    assert '"price":null' in line and "Café “x”" in line
    assert jsonl.read_jsonl(spark, path, schemas.PRODUCT).collect() == df.collect()


def test_policy_keeps_the_last_row(spark):
    rows = [(1, "A", "old"), (3, "A", "new"), (2, None, "x"), (4, "", "y"), (5, "B", None)]
    df = spark.createDataFrame(rows, "line_no bigint, category string, fee string")
    assert {tuple(r) for r in policy.load_policy(df).collect()} == {("A", "new"), ("B", None)}


def test_vectors_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p", [0.5, 1.0], "t")], "product_id string, embedding array<double>, title string")
    vectors.write_vectors(df, str(tmp_path / "v"))
    back = vectors.read_vectors(spark, str(tmp_path / "v"))
    assert back.schema["embedding"].dataType.simpleString() == "array<float>"
    assert back.collect()[0].embedding == [0.5, 1.0]


def test_counts_name_the_missing_category(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "category string")
    assert [tuple(r) for r in O.category_counts(df).collect()] == [("a", 1), ("b", 2), ("unknown", 1)]


def test_numbers_as_texts(spark):
    from aislekit.functions.text import number_text

    values = [0.0, 5.0, 12345678.0, 12345678.25, 0.0005, 0.001, 1e-4, 9.5e-5, 1e-05, 1e15, 1.5e16, 1e16, 123456789012345.6, 0.1 + 0.2, -0.00025, 1e100, 3e-300]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in df.select("i", number_text(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [repr(v) for v in values]


def test_prices_are_finite(spark):
    from aislekit.functions.products import price_of

    df = spark.createDataFrame([("inf",), ("1e999",), ("Infinity",), ("nan",), ("1e3",), (" 2.5 ",)], "p string")
    assert [r[0] for r in df.select(price_of(F.col("p"))).collect()] == [None, None, None, None, 1000.0, 2.5]
