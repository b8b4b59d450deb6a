"""The jobs from the command line: `python -m aislekit <job> --input … --output …`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislekit import schemas, vocabulary as V
from aislekit.functions.products import product_text
from aislekit.operators import catalog, chat, replies, sampling
from aislekit.plans import jobs
from aislekit.session import build_session
from aislekit.sources import jsonl, policy, runs, vectors as vector_tables
from aislekit.streaming import router


def _show_counts(df: DataFrame) -> None:
    catalog.category_counts(df).show(truncate=False)


def _policies(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return policy.read_policy(spark, a.shipping, schemas.SHIPPING), policy.read_policy(spark, a.returns, schemas.RETURNS)


def library(spark: SparkSession, a: argparse.Namespace) -> int:
    raw = jsonl.read_raw_meta(spark, a.input, a.cap, a.partitions)
    made = jobs.update_library(raw, a.state, a.max_rows, a.seed) if a.state else jobs.curate_library(raw, a.max_rows, a.seed)
    jsonl.write_jsonl(made, a.output)
    _show_counts(jsonl.read_jsonl(spark, a.output, schemas.PRODUCT))
    return 0


def demo_store(spark: SparkSession, a: argparse.Namespace) -> int:
    products = jsonl.read_jsonl(spark, a.input, schemas.PRODUCT)
    jsonl.write_jsonl(sampling.sample_n(products, a.max_rows, a.seed, "product_id"), a.output)
    _show_counts(jsonl.read_jsonl(spark, a.output, schemas.PRODUCT))
    return 0


def qa(spark: SparkSession, a: argparse.Namespace) -> int:
    lines = jsonl.read_numbered_lines(spark, a.input)
    rows = lines.select("file", "line_no", F.from_json("line", schemas.QA_RAW).alias("row")).where("row IS NOT NULL")
    sampled = sampling.sample_n(rows, a.max_rows, a.seed, ["file", "line_no"])
    jsonl.write_jsonl(catalog.qa_to_pairs(sampled.select("row.*")), a.output)
    return 0


def sample(spark: SparkSession, a: argparse.Namespace) -> int:
    lines = jsonl.read_numbered_lines(spark, a.input)
    sampling.reservoir_sample(lines, a.sample_size, a.seed, ["file", "line_no"]).select("line").write.text(a.output)
    return 0


def contexts(spark: SparkSession, a: argparse.Namespace) -> int:
    products = jsonl.read_jsonl(spark, a.input, schemas.PRODUCT)
    made = jobs.task_contexts(products, a.max_rows, a.seed)
    jsonl.write_jsonl(made.select("category", F.col("sub_category").alias("subcategory"), "products"), a.output)
    return 0


def product_texts(spark: SparkSession, a: argparse.Namespace) -> int:
    """What an embedding model is to embed, one text per product."""
    products = jsonl.read_jsonl(spark, a.input, schemas.PRODUCT)
    row = {c: F.col(c) for c in products.columns}
    jsonl.write_jsonl(products.select("product_id", product_text(row).alias("text")), a.output)
    return 0


def vectors(spark: SparkSession, a: argparse.Namespace) -> int:
    """A vector table out of embeddings and the products they belong to; vectors without a product are left out."""
    embeddings = jsonl.read_jsonl(spark, a.input, schemas.VECTOR)
    products = jsonl.read_jsonl(spark, a.products, schemas.PRODUCT)
    vector_tables.write_vectors(products.join(embeddings, "product_id"), a.output)
    return 0


def answer(spark: SparkSession, a: argparse.Namespace) -> int:
    products = vector_tables.read_vectors(spark, a.vectors).drop("embedding")
    answers = jobs.answer_shoppers(
        jsonl.read_jsonl(spark, a.input, schemas.SHOPPER_QUERY), vector_tables.open_vectors(spark, a.vectors), products,
        jsonl.read_jsonl(spark, a.history, schemas.TURN), *_policies(spark, a), a.system_prompt, a.top_k, a.threshold, a.always_listed,
    )
    jsonl.write_jsonl(answers, a.output)
    return 0


def route(spark: SparkSession, a: argparse.Namespace) -> int:
    """Questions with route, category and policy text, in one batch or, with --stream, as files arrive."""
    if a.stream:
        asked = spark.readStream.schema(schemas.SHOPPER_QUERY).json(a.input).drop("embedding")
        offsets = a.output.rstrip("/") + "_offsets"
        router.write_stream(router.route_stream(asked, *_policies(spark, a)), a.output, offsets).awaitTermination()
    else:
        asked = jsonl.read_jsonl(spark, a.input, schemas.SHOPPER_QUERY).drop("embedding")
        jsonl.write_jsonl(replies.policy_lookup(asked, *_policies(spark, a)), a.output)
    return 0


def tasks(spark: SparkSession, a: argparse.Namespace) -> int:
    products = jsonl.read_jsonl(spark, a.input, schemas.PRODUCT)
    contexts = jobs.task_contexts(products, a.max_rows, a.seed)
    made = jobs.review_tasks(contexts, {a.kind: None}, a.seed)[a.kind]
    jsonl.write_jsonl(made.drop("ctx_id"), a.output)
    return 0


def merge(spark: SparkSession, a: argparse.Namespace) -> int:
    parts = [jsonl.read_lines(spark, path, blank=True) for path in a.input]
    merged = chat.merge_sets(**{f"part_{i}": part for i, part in enumerate(parts)})
    merged.select("line").write.text(a.output)
    told = chat.reconcile(jsonl.read_lines(spark, a.output, blank=True), *parts).collect()[0]
    print(f"{told.part_rows} rows in, {told.merged_rows} rows out: {told.verdict}")
    return 0 if told.verdict == "match" else 1


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    report = chat.validate_until(spark, a.input, a.max_errors)
    print(f"Checked {report.total} rows: OK={report.ok}, ERRORS={len(report.errors)}")
    for _, line_no, reason in report.errors:
        print("  ", f"L{line_no}: {reason}")
    return 1 if report.errors else 0


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    cases = runs.read_test_cases(spark, a.input)
    results, metrics = jobs.test_report(sampling.head_n(cases, a.max_tests, "test_id"))
    jsonl.write_jsonl(results, a.output)
    jsonl.write_metrics(metrics, a.output.rstrip("/") + "_metrics")
    metrics.show(truncate=False, vertical=True)
    return 0


def edge_cases(spark: SparkSession, a: argparse.Namespace) -> int:
    cases = jsonl.read_jsonl(spark, a.input, schemas.EDGE_CASE)
    jsonl.write_jsonl(replies.edge_case_replies(cases, *_policies(spark, a)), a.output)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="aislekit", description=__doc__)
    top.add_argument("--shared", help="folder for intermediate tables that all executors reach; else spark.checkpoint.dir says it")
    jobs_of = top.add_subparsers(dest="job", required=True)

    def job(run, *, many: bool = False, output: bool = True, rows: int | None = None) -> argparse.ArgumentParser:
        p = jobs_of.add_parser(run.__name__.replace("_", "-"))
        p.set_defaults(run=run)
        p.add_argument("--input", required=True, nargs="+" if many else None)
        if output:
            p.add_argument("--output", required=True)
        if rows is not None:
            p.add_argument("--max-rows", type=int, default=rows)
            p.add_argument("--seed", type=int, default=42)
        return p

    p = job(library, many=True, rows=V.LIBRARY_ROWS)
    p.add_argument("--cap", type=int, default=None, help="rows read at most; all by default")
    p.add_argument("--partitions", type=int, default=None)
    p.add_argument("--state", help="folder of a library that new metadata are merged into")
    job(demo_store, rows=100)
    job(qa, rows=96_000)
    p = job(sample)
    p.add_argument("--sample-size", type=int, default=48_000)
    p.add_argument("--seed", type=int, default=42)
    p = job(tasks, rows=18_000)
    p.add_argument("--kind", choices=list(jobs.GENERATORS), required=True)
    job(merge, many=True)
    job(validate, output=False).add_argument("--max-errors", type=int, default=20)
    job(evaluate).add_argument("--max-tests", type=int, default=None)
    job(contexts, rows=18_000)
    job(product_texts)
    job(vectors).add_argument("--products", required=True)
    with_policies = [job(edge_cases), job(route), job(answer)]
    for p in with_policies:
        p.add_argument("--shipping", required=True)
        p.add_argument("--returns", required=True)
    with_policies[1].add_argument("--stream", action="store_true")
    p = with_policies[2]
    p.add_argument("--vectors", required=True)
    p.add_argument("--history", required=True)
    p.add_argument("--system-prompt", required=True)
    p.add_argument("--top-k", type=int, default=V.TOP_K)
    p.add_argument("--threshold", type=float, default=None)
    p.add_argument("--always-listed", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(build_session(**({"spark.checkpoint.dir": args.shared} if args.shared else {})), args)


if __name__ == "__main__":
    raise SystemExit(main())
