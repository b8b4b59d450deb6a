"""Task generators on random contexts full of gaps, against the step-by-step SQL, and their promises."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aislekit.operators import contexts as C
from aislekit.plans import tasks as T
from checks import base as B
from checks.compare import difference
from checks.tasks import TASK_SQL

FIELDS = ["product_id", "category", "title", "price", "brand", "features", "avg_rating"]


def make_contexts(n, seed):
    rng = random.Random(seed)
    pool = ["red", "Compact", "Glass lid", "Quiet", "Lightweight", "Timer"]
    out = []
    for ctx in range(n):
        few, cheap = rng.random() < 0.3, rng.random() < 0.2
        products = []
        for i in range(rng.randint(1, 8)):
            title = rng.choice(["Acme red pan - Kitchen", "Bolt lamp", "Acme", "", "lone - x", "Acme pot - a - b"])
            products.append({
                "product_id": f"p{rng.randint(0, 5) if rng.random() < 0.1 else i + 10}",
                "category": "pots_and_pans", "title": title,
                "price": rng.choice([None, 0.0, 5.0, 9.99, 10.0] if cheap else [None, 10.0, 10.01, 99.99, 200.0, 245.5]),
                "brand": rng.choice(["", "Acme", "Bolt"] if few else ["", "Acme", "Bolt", "Ninja", "Breville", "Core"]),
                "features": [rng.choice(pool[:2] if few else pool) for _ in range(rng.randint(0, 4))],
                "avg_rating": rng.choice([None, 3.0, 4.0, 4.5, 4.55, 5.0]),
            })
        out.append((ctx, products))
    return out


@pytest.fixture(scope="module")
def random_contexts(spark):
    from aislekit import schemas

    made = make_contexts(4000, 7)
    rows = [(ctx, [tuple(p[f] for f in FIELDS) for p in products]) for ctx, products in made]
    df = spark.createDataFrame(rows, f"ctx_id BIGINT, products ARRAY<{schemas.CONTEXT_PRODUCT}>")
    flat = [{"ctx_id": ctx, "pos": i, **p} for ctx, products in made for i, p in enumerate(products)]
    con = duckdb.connect()
    con.register("flat", pa.Table.from_pylist(flat, schema=pa.schema([
        ("ctx_id", pa.int64()), ("pos", pa.int64()), ("product_id", pa.string()), ("category", pa.string()),
        ("title", pa.string()), ("price", pa.float64()), ("brand", pa.string()), ("features", pa.list_(pa.string())),
        ("avg_rating", pa.float64()),
    ])))
    return df, con


@pytest.mark.parametrize("kind", ["pick_one", "pick_list", "reject", "clarify"])
def test_generator_agrees_with_steps(random_contexts, kind):
    df, con = random_contexts
    made = getattr(T, kind)(df, B.SEED).drop("product_context")
    for column, kind_of in made.dtypes:
        if kind_of == "array<string>":
            made = made.withColumn(column, F.array_join(column, "|"))
    sql, parts = TASK_SQL[kind]
    assert difference(made, con, B.chain(sql, ("ctxp", "SELECT * FROM flat"), *parts)) is None


def test_pick_one_names_the_target_or_all_that_match(random_contexts):
    df, _ = random_contexts
    made = T.pick_one_constraints(df, 3)
    met = F.transform(
        F.filter("products", lambda p: F.array_contains("satisfying_ids", p["product_id"])), lambda p: p["product_id"]
    )
    rows = made.select(
        F.size("satisfying_ids").alias("n"), F.array_contains("satisfying_ids", F.col("target.product_id")).alias("has"),
        (F.size(met) >= F.size("satisfying_ids")).alias("known"),
    ).collect()
    assert all(r.has and r.known for r in rows)
    assert sum(r.n == 1 for r in rows) > 0.7 * len(rows)


def test_pick_list_has_two_unless_the_context_cannot(random_contexts):
    df, _ = random_contexts
    made = T.pick_list_constraints(df, 3)
    short = made.where(F.size("satisfying_ids") < 2)
    # With the last ceiling alone, only a price above it can keep a product out.
    over = F.filter("products", lambda p: p["price"] > F.col("constraint.max_price"))
    assert short.where(F.size("products") - F.size(over) >= 2).count() == 0


def test_reject_matches_nothing_unless_unknown_values_pass(random_contexts):
    df, _ = random_contexts
    left = C.satisfying_ids(T.reject_constraints(df, 3)).where(F.size("satisfying_ids") > 0)
    gap = F.exists("products", lambda p: p["price"].isNull() | p["avg_rating"].isNull() | (p["price"] <= 0))
    assert left.where(~gap).count() == 0


def test_clarify_asks_at_most_three(random_contexts):
    df, _ = random_contexts
    n = F.size(F.filter(F.split("reply", "\n"), lambda line: line.startswith("- ")))
    assert T.clarify(df, 3).where((n > 3) | (n < 0)).count() == 0


def test_seed_alone_decides(random_contexts):
    df, _ = random_contexts
    def texts(d, seed):
        return {r.ctx_id: (r.query, r.reply) for r in T.pick_list(d, seed).select("ctx_id", "query", "reply").collect()}

    once = texts(df, 5)
    assert once == texts(df.repartition(13), 5)
    assert once != texts(df, 6)
