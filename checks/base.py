"""The registry, and the tables the jobs expect, made from the driver's tables.

The `…_SQL` texts run unchanged on Spark and on DuckDB. Odd values (broken JSON, missing
prices, blank titles) are planted by rule; no row of a table is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aislekit.operators.catalog import extract_products
from aislekit.operators.contexts import build_contexts
from aislekit.session import spread, written

SEED = 42
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query, and its SQL where there is one."""
    def keep(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- tables ---------------------------------------------------------------------------

RAW_META_SQL = """
SELECT
  CASE p_type WHEN 'ECONOMY' THEN 'Home_and_Kitchen' WHEN 'SMALL' THEN 'ARTS_AND_CRAFTS'
    WHEN 'STANDARD' THEN 'grocery_and_gourmet_food' WHEN 'LARGE' THEN 'All_Beauty'
    WHEN 'MEDIUM' THEN 'tools' ELSE 'Home & Kitchen' END AS main_category,
  CASE WHEN p_partkey % 31 = 0 THEN '[]'
    WHEN p_partkey % 47 = 0 THEN '[[]]'
    WHEN p_partkey % 2 = 0 THEN concat('[["Store","', split_part(p_name, ' ', 2), ' sets"],["Other"]]')
    ELSE concat('["Store","', split_part(p_name, ' ', 2), ' sets"]') END AS categories,
  CASE WHEN p_partkey % 19 = 0 THEN '"single"'
    WHEN p_partkey % 43 = 0 THEN concat('["', split_part(p_name, ' ', 1), '","', split_part(p_name, ' ', 1), '"]')
    ELSE concat('["', split_part(p_name, ' ', 1), '","',
      CASE p_size % 5 WHEN 0 THEN 'Compact' WHEN 1 THEN 'Stainless Steel' WHEN 2 THEN 'Dishwasher Safe'
        WHEN 3 THEN 'Quiet' ELSE 'Lightweight' END, '","',
      CASE p_partkey % 7 WHEN 0 THEN 'Organic' WHEN 1 THEN 'Durable' WHEN 2 THEN 'Ergonomic' WHEN 3 THEN 'Gentle'
        WHEN 4 THEN 'Non-stick' WHEN 5 THEN 'Programmable' ELSE 'Natural' END, '"]') END AS features,
  CASE WHEN p_partkey % 17 = 0 THEN 'None'
    WHEN p_partkey % 23 = 0 THEN concat('$', CAST(p_retailprice AS STRING))
    WHEN p_partkey % 61 = 0 THEN '12345678.25' WHEN p_partkey % 67 = 0 THEN '0.0005' 
    ELSE CAST(p_retailprice AS STRING) END AS price,
  CASE WHEN p_partkey % 37 = 0 THEN '{"Brand": broken'
    WHEN p_partkey % 41 = 0 THEN NULL
    WHEN p_partkey % 2 = 0 THEN concat('{"Brand": "', p_brand, '", "Color": "red"}')
    ELSE concat('{"brand": "', p_brand, '"}') END AS details,
  concat('P', CAST(p_partkey AS STRING)) AS parent_asin,
  CASE WHEN p_partkey % 29 = 0 THEN ''
    WHEN p_partkey % 53 = 0 THEN concat(p_brand, ' ', p_name)
    ELSE concat(p_brand, ' ', p_name, ' - ', p_type) END AS title,
  CASE WHEN p_partkey % 59 = 0 THEN NULL
    ELSE CAST(CAST(30 + (p_partkey * 7) % 21 AS DOUBLE) / 10 AS STRING) END AS average_rating
FROM {part}
"""

SHIPPING_SQL = """
SELECT s_suppkey AS line_no,
  CASE s_suppkey % 6 WHEN 0 THEN 'Home_and_Kitchen' WHEN 1 THEN 'Grocery_and_Gourmet_Food'
    WHEN 2 THEN 'Arts_Crafts_and_Sewing' WHEN 3 THEN 'Health_and_Household'
    WHEN 4 THEN 'Tools_and_Home_Improvement' ELSE NULL END AS category,
  CAST(3 + s_nationkey % 5 AS STRING) AS standard_days,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(1 + s_nationkey % 3 AS STRING) END AS express_days,
  '1' AS overnight_days,
  '0' AS standard_cost,
  CAST(s_acctbal AS STRING) AS express_cost,
  CAST(20 + s_nationkey AS STRING) AS overnight_cost
FROM {supplier}
"""

RETURNS_SQL = """
SELECT s_suppkey AS line_no,
  CASE s_suppkey % 6 WHEN 0 THEN 'Home_and_Kitchen' WHEN 1 THEN 'Grocery_and_Gourmet_Food'
    WHEN 2 THEN 'Arts_Crafts_and_Sewing' WHEN 3 THEN '' WHEN 4 THEN 'Tools_and_Home_Improvement'
    ELSE NULL END AS category,
  concat(CAST(10 + s_nationkey AS STRING), ' days') AS return_window,
  s_name AS condition,
  CAST(s_nationkey AS STRING) AS restocking_fee,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Keep the box' END AS special_notes
FROM {supplier}
"""

SHOPPER_SQL = """
SELECT event_id AS query_id,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN ''
    ELSE concat(
      CASE event_id % 9 WHEN 0 THEN 'How long does it take to get' WHEN 1 THEN 'What is the RETURN policy for'
        WHEN 2 THEN 'Find me' WHEN 3 THEN 'What is the retail price of' WHEN 4 THEN 'Do you ship or refund'
        WHEN 5 THEN 'CAN I RETURN' WHEN 6 THEN 'Is there a warranty on' WHEN 7 THEN 'When does it ARRIVE:'
        ELSE 'I want to compare' END, ' ',
      CASE event_type WHEN 'signup' THEN 'Health vitamins' WHEN 'view' THEN 'kitchen food'
        WHEN 'click' THEN 'a power drill' WHEN 'error' THEN 'organic snacks' ELSE 'crayola paint' END, '?') END AS user_query
FROM {events}
"""

RAW_REPLIES_SQL = """
SELECT conv_id * 100000 + turn AS query_id,
  CASE (conv_id + turn) % 5 WHEN 0 THEN 'How long does shipping take for tools?'
    WHEN 1 THEN 'Can I get a refund on coffee?' WHEN 2 THEN 'Is there a warranty on vitamins?'
    WHEN 3 THEN NULL ELSE text END AS user_query,
  CASE (conv_id * 7 + turn) % 16
    WHEN 0 THEN concat(text, ' STOP')
    WHEN 1 THEN concat('<|start|>', text, '<|end|>')
    WHEN 2 THEN concat('one | two ', text)
    WHEN 3 THEN concat('Available products: [ {"x":', chr(10), ' 1} ] ', text)
    WHEN 4 THEN concat(text, ' Would you like more? Yes it is.')
    WHEN 5 THEN concat(text, ' Nice. What ')
    WHEN 6 THEN '  [TOOL: get_shipping_speed]'
    WHEN 7 THEN concat('[TOOL:get_return_policy] ', text)
    WHEN 8 THEN 'STOP'
    WHEN 9 THEN concat(text, ' |endoftool| I am Finished. Stop. Please note that shipping times may vary a lot. Bye')
    WHEN 10 THEN concat('\u00a0', text, '\u2003', ' | Finish |')
    WHEN 11 THEN ''
    WHEN 12 THEN NULL
    WHEN 13 THEN concat(text, ' If you''re looking for more, ask me! END STOP')
    WHEN 14 THEN '[TOOL: get_return_policy]'
    ELSE text END AS raw_reply,
  CASE (conv_id + turn) % 3 WHEN 0 THEN NULL WHEN 1 THEN 'It takes 3 days. [TOOL: get_shipping_speed] Let me know. STOP'
    ELSE ' Stop ' END AS followup_reply,
  CASE WHEN (conv_id * 3 + turn) % 17 = 0 THEN 'out of memory' END AS error
FROM {conversations}
"""

TEST_CASES_SQL = """
SELECT k AS test_id, product_id, title, price, brand, features, avg_rating,
  CASE k % 16 WHEN 0 THEN concat('What is the price of ', title, '?') WHEN 1 THEN 'How much is it?'
    WHEN 2 THEN 'How is it rated?' WHEN 3 THEN 'Which company makes it?' WHEN 4 THEN 'What features does it have?'
    WHEN 5 THEN 'Is it organic?' WHEN 6 THEN 'Does it come dishwasher safe?' WHEN 7 THEN 'Is it blue?'
    WHEN 8 THEN 'How fast is delivery?' WHEN 9 THEN 'Can I get a refund?' WHEN 10 THEN concat('Tell me about ', title)
    WHEN 11 THEN 'Has it got a durable build?' WHEN 12 THEN 'How many stars?' WHEN 13 THEN 'Which manufacturer?'
    WHEN 14 THEN 'Hello' ELSE 'IS IT EXPENSIVE?' END AS user_query,
  CASE k % 13 WHEN 0 THEN concat('It costs $', CASE WHEN price IS NULL THEN '?' WHEN price < 0.001 THEN '0.0005'
      WHEN price > 10000000 THEN '12345678.25' ELSE CAST(price AS STRING) END, ' at the moment.')
    WHEN 1 THEN 'price: 12.50 dollars'
    WHEN 2 THEN concat('It has a rating: ', coalesce(CAST(avg_rating AS STRING), '4'), ' stars')
    WHEN 3 THEN concat('The Brand: ', brand, ' is its maker')
    WHEN 4 THEN 'Features: Compact, organic, Durable and Quiet'
    WHEN 5 THEN 'Yes, indeed. It is organic and dishwasher safe.'
    WHEN 6 THEN 'No, not so.' WHEN 7 THEN 'Standard shipping takes 5 days.'
    WHEN 8 THEN 'The return window is 30 days.' WHEN 9 THEN concat('The product ', title, ' is great')
    WHEN 10 THEN '   ' WHEN 11 THEN 'Sorry, it is not available' ELSE 'ok' END AS agent_reply,
  CAST(k % 50 AS DOUBLE) / 10 AS response_time,
  CASE WHEN k % 61 = 0 THEN 'model timed out' END AS error
FROM (SELECT *, CAST(substr(product_id, 2) AS BIGINT) AS k FROM {library})
"""


def _run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    for name, df in tables.items():
        view = f"{name}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        sql = sql.replace("{" + name + "}", view)
    return spark.sql(sql)


def raw_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, RAW_META_SQL, part=table(spark, sf_dir, "part"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_products(raw_meta(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One context per customer."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS ctx_id")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products are written once, since drawing reads them more than once. Their rows are dealt to all tasks before
    they are parsed, since one file may hold them all."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    products = extract_products(_run(spark, RAW_META_SQL, part=spread(part)))
    return build_contexts(requests(spark, sf_dir), written(products, "library"), SEED)


def policies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    supplier = table(spark, sf_dir, "supplier")
    return _run(spark, SHIPPING_SQL, supplier=supplier), _run(spark, RETURNS_SQL, supplier=supplier)


def shopper_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, SHOPPER_SQL, events=table(spark, sf_dir, "events"))


def raw_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, RAW_REPLIES_SQL, conversations=table(spark, sf_dir, "conversations"))


def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, TEST_CASES_SQL, library=library(spark, sf_dir))


# ---- SQL for the same tables ------------------------------------------------------------


def digest(salt: str, *keys: str) -> str:
    """The md5 draw of the package as SQL."""
    return f"md5(concat_ws(':', '{SEED}', '{salt}', " + ", ".join(keys) + "))"


def unit(drawn: str) -> str:
    return f"(('0x' || substr({drawn}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def uniform(drawn: str, low: float, high: float) -> str:
    return f"({float(low)}::DOUBLE + {float(high) - float(low)!r}::DOUBLE * {unit(drawn)})"


def index(drawn: str, size: str) -> str:
    return f"floor({unit(drawn)} * ({size}))::BIGINT"


def pick(values: str, drawn: str) -> str:
    return f"({values})[1 + {index(drawn, f'len({values})')}]"


def choose(options: list[str], drawn: str) -> str:
    return pick("[" + ", ".join(text(o) for o in options) + "]", drawn)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _plain(sql: str) -> str:
    for name in ("part", "supplier", "events", "conversations", "library"):
        sql = sql.replace("{" + name + "}", name)
    return sql


def _category_case(column: str) -> str:
    from aislekit import vocabulary as V

    arms = " ".join(
        f"WHEN lower({column}) IN ({', '.join(text(n) for n in names)}) THEN {text(target)}"
        for target, names in V.RAW_CATEGORY_NAMES.items()
    )
    return f"CASE {arms} END"


LIBRARY_SQL = f"""
SELECT parent_asin AS product_id, {_category_case('main_category')} AS category,
  CASE WHEN json_array_length(categories) = 0 THEN ''
    WHEN json_type(categories, '$[0]') = 'ARRAY' AND json_array_length(categories, '$[0]') > 0
      THEN json_extract_string(categories, '$[0][#-1]')
    ELSE json_extract_string(categories, '$[#-1]') END AS sub_category,
  title, TRY_CAST(price AS DOUBLE) AS price,
  coalesce(
    json_extract_string(CASE WHEN json_valid(details) THEN details END, '$.Brand'),
    json_extract_string(CASE WHEN json_valid(details) THEN details END, '$.brand'), '') AS brand,
  CASE WHEN json_type(features) = 'ARRAY' THEN from_json(features, '["VARCHAR"]') ELSE [] END AS features,
  TRY_CAST(average_rating AS DOUBLE) AS avg_rating
FROM raw_meta
WHERE {_category_case('main_category')} IS NOT NULL AND length(parent_asin) > 0 AND length(title) > 0
"""


def _floyd(k: int) -> str:
    """Sampling k of n_products positions, one step per nested select."""
    sql = "SELECT ctx_id, category, sub_category, n_products, []::BIGINT[] AS chosen FROM drawn WHERE n_products >= 8"
    for i in range(1, k + 1):
        last = f"(n_products - {k} + {i})"
        guess = f"(floor({unit(digest('position', 'ctx_id', str(i)))} * {last})::BIGINT + 1)"
        sql = (
            f"SELECT ctx_id, category, sub_category, n_products, list_append(chosen, "
            f"CASE WHEN list_contains(chosen, {guess}) THEN {last} ELSE {guess} END) AS chosen FROM ({sql})"
        )
    return sql


_CTES = {
    "raw_meta": _plain(RAW_META_SQL),
    "library": LIBRARY_SQL,
    "shipping": _plain(SHIPPING_SQL),
    "returns": _plain(RETURNS_SQL),
    "shopper": _plain(SHOPPER_SQL),
    "raw_replies": _plain(RAW_REPLIES_SQL),
    "test_cases": _plain(TEST_CASES_SQL),
    "subs": """SELECT category, sub_category, count(*) AS n_products,
      row_number() OVER (PARTITION BY category ORDER BY sub_category) AS sub_no
      FROM library WHERE length(category) > 0 AND length(sub_category) > 0 GROUP BY category, sub_category""",
    "cats": """SELECT category, count(*) AS n_subs, row_number() OVER (ORDER BY category) AS category_no
      FROM subs GROUP BY category""",
    "drawn": f"""SELECT ctx_id, subs.category, sub_category, n_products FROM (
        SELECT c_custkey AS ctx_id,
          floor({unit(digest('category', 'c_custkey'))} * (SELECT count(*) FROM cats)) + 1 AS category_no
        FROM customer) JOIN cats USING (category_no)
      JOIN subs ON subs.category = cats.category
        AND sub_no = floor({unit(digest('sub_category', 'ctx_id'))} * n_subs) + 1""",
    "wanted": f"""SELECT ctx_id, category, sub_category, position,
        {digest('place', 'ctx_id', 'position')} AS place
      FROM (SELECT *, unnest(chosen) AS position FROM ({_floyd(8)}))
      UNION ALL SELECT ctx_id, category, sub_category, unnest(range(1, n_products + 1)) AS position, '' AS place
      FROM drawn WHERE n_products < 8""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY category, sub_category
        ORDER BY substr(md5(product_id), 1, 3), product_id) AS position
      FROM library WHERE length(category) > 0 AND length(sub_category) > 0""",
    "ctxp": """SELECT ctx_id, row_number() OVER (PARTITION BY ctx_id ORDER BY place, product_id) - 1 AS pos,
        product_id, category AS main_category, sub_category, replace(lower(sub_category), ' ', '_') AS category,
        title, price, brand, features, avg_rating
      FROM wanted JOIN numbered USING (category, sub_category, position)""",
}
_NEEDS = {
    "library": ["raw_meta"], "test_cases": ["raw_meta", "library"],
    "subs": ["raw_meta", "library"], "cats": ["raw_meta", "library", "subs"],
    "drawn": ["raw_meta", "library", "subs", "cats"],
    "ctxp": ["raw_meta", "library", "subs", "cats", "drawn", "wanted", "numbered"],
}


def using(name: str, sql: str, *more: tuple[str, str]) -> str:
    """SQL on the named table, with the tables it needs and `more` put in front."""
    names = [*_NEEDS.get(name, []), name]
    parts = [f"{n} AS MATERIALIZED ({_CTES[n]})" for n in names] + [f"{n} AS MATERIALIZED ({s})" for n, s in more]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def using_all(names: list[str], sql: str, *more: tuple[str, str]) -> str:
    """Like `using`, for several tables."""
    wanted = list(dict.fromkeys(n for name in names for n in [*_NEEDS.get(name, []), name]))
    parts = [f"{n} AS MATERIALIZED ({_CTES[n]})" for n in wanted] + [f"{n} AS MATERIALIZED ({s})" for n, s in more]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def chain(sql: str, *parts: tuple[str, str]) -> str:
    """SQL on the given parts alone."""
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in parts) + "\n" if parts else "") + sql
