"""Fixed schemas of the tables, as DDL texts."""

from __future__ import annotations

# Nested or mixed-type JSON fields are read as text and typed afterwards.
RAW_META = (
    "main_category STRING, categories STRING, features STRING, price STRING, details STRING, "
    "parent_asin STRING, title STRING, average_rating STRING"
)
PRODUCT = (
    "product_id STRING, category STRING, sub_category STRING, title STRING, price DOUBLE, "
    "brand STRING, features ARRAY<STRING>, avg_rating DOUBLE"
)
QA_RAW = ("query STRING, answer STRING")
SHIPPING = (
    "line_no BIGINT, category STRING, standard_days STRING, express_days STRING, overnight_days STRING, "
    "standard_cost STRING, express_cost STRING, overnight_cost STRING"
)
RETURNS = (
    "line_no BIGINT, category STRING, return_window STRING, condition STRING, "
    "restocking_fee STRING, special_notes STRING"
)
TEST_CASE = (
    "test_id BIGINT, product_id STRING, title STRING, price DOUBLE, brand STRING, features ARRAY<STRING>, "
    "avg_rating DOUBLE, user_query STRING, agent_reply STRING, response_time DOUBLE, error STRING"
)
EDGE_CASE = (
    "query_id BIGINT, user_query STRING, raw_reply STRING, followup_reply STRING, error STRING"
)
SHOPPER_QUERY = ("query_id BIGINT, conv_id BIGINT, user_query STRING, embedding ARRAY<FLOAT>")
TURN = ("conv_id BIGINT, turn BIGINT, role STRING, text STRING")
VECTOR = ("product_id STRING, embedding ARRAY<FLOAT>")
CONTEXT_PRODUCT = (
    "STRUCT<product_id: STRING, category: STRING, title: STRING, price: DOUBLE, "
    "brand: STRING, features: ARRAY<STRING>, avg_rating: DOUBLE>"
)
