"""Whole jobs: raw metadata to training rows, shopper questions to answers, test runs to metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit import vocabulary as V
from aislekit.operators.catalog import extract_products
from aislekit.operators.chat import assemble_messages, merge_sets, prompt_of
from aislekit.operators.contexts import build_contexts, context_requests
from aislekit.operators.metrics import all_metrics, evaluate_runs
from aislekit.operators.replies import policy_lookup
from aislekit.operators.retrieval import context_json, search
from aislekit.operators.sampling import merge_quota, quota_sample
from aislekit.plans import tasks
from aislekit.session import written
from aislekit.sources.vectors import VectorStore

GENERATORS = {
    "pick_one": tasks.pick_one, "pick_list": tasks.pick_list, "reject": tasks.reject, "clarify": tasks.clarify,
}
# Tasks of each kind in a full set.
TASK_COUNTS = {"pick_one": 18_000, "pick_list": 27_000, "reject": 14_400, "clarify": 3_600}


def curate_library(raw: DataFrame, max_rows: int = V.LIBRARY_ROWS, seed: int = 42) -> DataFrame:
    """A product library with an equal quota for each target category.

    The parsed products are written once: the quota looks at their keys twice before it
    reads the rows, and parsing JSON three times costs more than a columnar table.
    """
    return quota_sample(written(extract_products(raw), "products"), max_rows, seed)


def update_library(raw: DataFrame, path: str, max_rows: int = V.LIBRARY_ROWS, seed: int = 42) -> DataFrame:
    """The library of all raw metadata so far; earlier metadata are not read again.

    Every update writes a version of its own beside the earlier ones, and the latest one that was finished counts.
    Later updates keep `max_rows` and `seed`.
    """
    spark, new = raw.sparkSession, written(extract_products(raw), "products")
    path = path.rstrip("/")
    version = _last_version(spark, path)
    rows = quota_sample(new, max_rows, seed) if version is None else merge_quota(
        spark.read.schema(new.schema).parquet(f"{path}/version={version}"), new, max_rows, seed)
    version = 0 if version is None else version + 1
    rows.write.parquet(f"{path}/version={version}")
    return spark.read.schema(new.schema).parquet(f"{path}/version={version}")


def _last_version(spark: SparkSession, path: str) -> int | None:
    """The latest version that its writer has finished."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(root)
    return max((int(s.getPath().getParent().getName().split("=")[1]) for s in found or []), default=None)


def task_contexts(library: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n contexts, written once for all generators."""
    requests = context_requests(library.sparkSession, n)
    return written(build_contexts(requests, library, seed), "contexts")


def review_tasks(contexts: DataFrame, counts: dict[str, int] | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """The task tables by kind; each kind uses the contexts 0 … count-1, None means all."""
    counts = TASK_COUNTS if counts is None else counts
    return {
        kind: GENERATORS[kind](contexts if n is None else contexts.where(F.col("ctx_id") < n), seed)
        for kind, n in counts.items()
    }


def review_set(made: dict[str, DataFrame]) -> DataFrame:
    """All tasks as one table with the kind as `source`: ctx_id, task, query, answer ids, reply."""
    none = F.lit(None)
    shaped = {}
    for kind, df in made.items():
        ids = next((c for c in ("satisfying_ids", "predicted_ids") if c in df.columns), None)
        shaped[kind] = df.select(
            "ctx_id", "task", "query", "product_context",
            (F.col(ids) if ids else none.cast("array<string>")).alias("answer_ids"),
            (F.col("reply") if "reply" in df.columns else none.cast("string")).alias("reply"),
        )
    return merge_sets(**shaped)


def answer_shoppers(
    queries: DataFrame, vectors: DataFrame | VectorStore, products: DataFrame, history: DataFrame,
    shipping: DataFrame, returns: DataFrame, system_prompt: str,
    k: int = V.TOP_K, threshold: float | None = None, always_listed: bool = False,
) -> DataFrame:
    """(query_id, route, policy_text, prompt): a policy text, or the prompt of a product search.

    `queries` holds query_id, conv_id, user_query and embedding. Routing comes first, so
    only the questions that need products pay for the search. `vectors` are a table or an open store. `always_listed`: see `assemble_messages`.
    """
    routed = policy_lookup(queries, shipping, returns)
    told = routed.where("route <> 'search'").select(
        "query_id", "route", "policy_text", F.lit(None).cast("string").alias("prompt")
    )
    asked = routed.where("route = 'search'").select("query_id", "conv_id", F.col("user_query").alias("query"), "embedding")
    # Only vectors of known products can be hits; ranked after that, a list holds k of them.
    if isinstance(vectors, VectorStore):
        offered = vectors.among(products)
    else:
        offered = vectors.join(products.select("product_id"), "product_id", "left_semi")
    hits = search(asked, offered, k, threshold).join(products, "product_id")
    found = context_json(hits)
    messages = assemble_messages(asked.drop("embedding").join(found, "query_id", "left"), history, system_prompt, always_listed)
    prompted = messages.select(
        "query_id", F.lit("search").alias("route"), F.lit(None).cast("string").alias("policy_text"),
        prompt_of(F.col("messages")).alias("prompt"),
    )
    return told.unionByName(prompted)


def test_report(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The result rows and the metrics document of a test run; the rows are written once for both."""
    results = written(evaluate_runs(runs), "results")
    return results, all_metrics(results)
