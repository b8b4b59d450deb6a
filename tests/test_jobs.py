"""The jobs from files to files, through the command line."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from aislekit import schemas
from aislekit.__main__ import main
from aislekit.operators.metrics import evaluate_runs
from aislekit.sources import jsonl, policy, runs


def lines_of(path):
    return [line for p in sorted(path.glob("part-*")) for line in p.read_text(encoding="utf-8").splitlines()]


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of 2,000 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key in old:
        spark.conf.set(key, "2000")
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def test_line_numbers_over_blocks_and_files(spark, small_blocks, tmp_path):
    for name, n in (("a", 1500), ("b", 700)):
        (tmp_path / f"{name}.txt").write_text("\n".join("" if i % 10 == 3 else f"{name} {i}" for i in range(1, n + 1)))
    got = jsonl.read_numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    rows = got.collect()
    assert len(rows) == 1350 + 630
    assert all(r.line == f"{r.file[-5]} {r.line_no}" for r in rows)


def test_policy_file_keeps_the_last_line(spark, small_blocks, tmp_path):
    path = tmp_path / "shipping.jsonl"
    path.write_text("\n".join(json.dumps({"category": f"C{i % 7}", "standard_days": str(i), "express_cost": 1.5}) for i in range(700)))
    rows = policy.read_policy(spark, str(path), schemas.SHIPPING)
    last = {r.category: (r.standard_days, r.express_cost) for r in policy.load_policy(rows).collect()}
    assert last == {f"C{i}": (str(693 + i), "1.5") for i in range(7)}


def test_metadata_to_tasks(spark, tmp_path):
    names = ["Home_and_Kitchen", "tools", "all_beauty", "Books"]
    raw = [
        {"main_category": names[i % 4], "categories": [["Top", f"Sub {i % 3}"]], "features": ["red", f"f{i % 5}"], "price": 10 + i % 50,
         "details": {"Brand": f"B{i % 4}"}, "parent_asin": f"A{i}", "title": f"B{i % 4} pan {i} - x", "average_rating": 3 + i % 3}
        for i in range(400)
    ]
    (tmp_path / "meta.jsonl.gz").write_bytes(gzip.compress("\n".join(json.dumps(r) for r in raw).encode()))
    library, store = tmp_path / "library", tmp_path / "store"
    assert main(["library", "--input", str(tmp_path / "meta.jsonl.gz"), "--output", str(library), "--max-rows", "300"]) == 0
    kept = jsonl.read_jsonl(spark, str(library), schemas.PRODUCT)
    assert {r.category: r["count"] for r in kept.groupBy("category").count().collect()} == {
        "Home_and_Kitchen": 60, "Tools_and_Home_Improvement": 60, "Health_and_Household": 60
    }
    assert main(["demo-store", "--input", str(library), "--output", str(store)]) == 0
    assert len(lines_of(store)) == 100
    for kind in ("pick_one", "pick_list", "reject", "clarify"):
        assert main(["tasks", "--kind", kind, "--input", str(library), "--output", str(tmp_path / kind), "--max-rows", "50"]) == 0
        made = [json.loads(line) for line in lines_of(tmp_path / kind)]
        assert len(made) == 50 and all(m["task"] == kind and m["query"] and 1 <= len(m["product_context"]) <= 8 for m in made)
    again = tmp_path / "again"
    main(["tasks", "--kind", "reject", "--input", str(library), "--output", str(again), "--max-rows", "50"])
    assert sorted(lines_of(again)) == sorted(lines_of(tmp_path / "reject"))


def test_sample_merge_validate(spark, tmp_path, capsys):
    chat = [{"messages": [{"role": r, "content": f"{r} {i}"} for r in ("system", "user", "assistant")]} for i in range(60)]
    (tmp_path / "one.jsonl").write_text("\n".join(json.dumps(c) for c in chat))
    (tmp_path / "two.jsonl").write_text("\n\n".join(json.dumps(c) for c in chat[:10]) + "\n{bad\n")
    assert main(["sample", "--input", str(tmp_path / "one.jsonl"), "--output", str(tmp_path / "few"), "--sample-size", "25"]) == 0
    assert len(set(lines_of(tmp_path / "few"))) == 25
    assert main(["merge", "--input", str(tmp_path / "few"), str(tmp_path / "two.jsonl"), "--output", str(tmp_path / "all")]) == 0
    assert "45 rows in, 45 rows out: match" in capsys.readouterr().out
    assert main(["validate", "--input", str(tmp_path / "one.jsonl")]) == 0
    assert main(["validate", "--input", str(tmp_path / "two.jsonl")]) == 1
    out = capsys.readouterr().out
    assert "Checked 60 rows: OK=60, ERRORS=0" in out and "Checked 11 rows: OK=10, ERRORS=1" in out and "L20: invalid JSON" in out


def test_published_test_table(spark, tmp_path):
    """Ids by line, absent fields as 0 or empty, written nulls as nulls."""
    lines = [
        {"product_id": "a", "title": "Pan", "price": 5.0, "features": ["x"], "user_query": "How is it rated?", "agent_reply": "It has a rating: 4.5 stars, all in all."},
        {"product_id": "b", "title": "Pot", "price": None, "features": [], "user_query": "What is the price?", "agent_reply": "The price is $7.00 at the moment."},
        {"product_id": "c", "title": "Lid", "price": 1.0, "features": None, "user_query": None, "agent_reply": "ok"},
        {"test_id": 77, "product_id": "d", "title": "Cup", "brand": "B", "user_query": "Which company makes it?", "agent_reply": "The brand: B makes this cup."},
    ]
    path = tmp_path / "tests.jsonl"
    path.write_text("\n\n".join(json.dumps(x) for x in lines[:2]) + "\n{broken\n" + "\n".join(json.dumps(x) for x in lines[2:]))
    rows = {r.product_id: r for r in runs.read_test_cases(spark, str(path)).collect()}
    assert {k: r.test_id for k, r in rows.items()} == {"a": 1, "b": 3, "c": 5, "d": 77}
    assert rows["a"].brand == "" and rows["a"].avg_rating == 0.0 and rows["b"].price is None and rows["c"].features is None
    assert rows["d"].price == 0.0 and rows["d"].features == [] and rows["a"].error is None
    told = {r.product_id: r for r in evaluate_runs(runs.read_test_cases(spark, str(path))).collect()}
    assert "Rating information present but no expected rating to compare" in told["a"].evaluation.issues
    assert told["b"].evaluation.error and told["c"].agent_reply == "ERROR: 'NoneType' object has no attribute 'lower'"
    assert told["d"].evaluation.is_accurate


def test_qa(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text("\n".join(json.dumps({"query": f"q{i}", "answer": f"a{i}"}) for i in range(30)))
    main(["qa", "--input", str(tmp_path / "qa.jsonl"), "--output", str(tmp_path / "out"), "--max-rows", "12"])
    rows = [json.loads(line) for line in lines_of(tmp_path / "out")]
    assert len(rows) == 12 and all(r["user"][1:] == r["assistant"][1:] for r in rows)


def test_evaluate_and_edge_cases(spark, tmp_path, small):
    from checks import base as B

    jsonl.write_jsonl(B.test_cases(spark, small), str(tmp_path / "runs"))
    assert main(["evaluate", "--input", str(tmp_path / "runs"), "--output", str(tmp_path / "results"), "--max-tests", "40"]) == 0
    assert len(lines_of(tmp_path / "results")) == 40
    metrics = json.loads(lines_of(tmp_path / "results_metrics")[0])
    assert metrics["total_tests"] == 40 and 0 < metrics["success_rate"] <= 1 and metrics["query_type_accuracy"]

    shipping, returns = B.policies(spark, small)
    for name, df in (("shipping", shipping), ("returns", returns)):
        df.orderBy("line_no").coalesce(1).select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(str(tmp_path / name))
    jsonl.write_jsonl(B.raw_replies(spark, small), str(tmp_path / "cases"))
    assert main([
        "edge-cases", "--input", str(tmp_path / "cases"), "--output", str(tmp_path / "told"),
        "--shipping", str(tmp_path / "shipping"), "--returns", str(tmp_path / "returns"),
    ]) == 0
    from checks.routing import edge_case_replies

    told = {(r["query_id"], r["agent_reply"]) for r in map(json.loads, lines_of(tmp_path / "told"))}
    assert told == {(r.query_id, r.agent_reply) for r in edge_case_replies(spark, small).collect()}


def test_shoppers_from_files_to_answers(spark, tmp_path):
    """contexts, product texts, vectors, answers and routes, all through the command line."""
    def write(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
        return str(tmp_path / name)

    products = [{"product_id": f"p{i}", "category": "Home_and_Kitchen", "sub_category": "Pans", "title": f"Pan {i}", "price": 5.0 + i,
                 "brand": "B", "features": ["x"], "avg_rating": 4.0} for i in range(12)]
    library = write("library.jsonl", products)
    assert main(["contexts", "--input", library, "--output", str(tmp_path / "contexts"), "--max-rows", "5"]) == 0
    made = [json.loads(x) for x in lines_of(tmp_path / "contexts")]
    assert len(made) == 5 and all(c["subcategory"] == "Pans" and len(c["products"]) == 8 for c in made)
    assert main(["product-texts", "--input", library, "--output", str(tmp_path / "texts")]) == 0
    assert json.loads(lines_of(tmp_path / "texts")[0])["text"].startswith("Pan 0 B Home_and_Kitchen Pans $5.0")
    vectors = write("vectors.jsonl", [{"product_id": f"p{i}", "embedding": [1.0, i / 10]} for i in range(14)])
    assert main(["vectors", "--input", vectors, "--products", library, "--output", str(tmp_path / "store")]) == 0
    asked = write("asked.jsonl", [{"query_id": 1, "conv_id": 1, "user_query": "any pan?", "embedding": [1.0, 0.0]},
                                  {"query_id": 2, "conv_id": 2, "user_query": "How long does delivery take?", "embedding": [1.0, 0.0]}])
    history = write("history.jsonl", [{"conv_id": 1, "turn": 0, "role": "user", "text": "hi"}])
    shipping = write("shipping.jsonl", [{"category": "Home_and_Kitchen", "standard_days": "5"}])
    returns = write("returns.jsonl", [{"category": "Home_and_Kitchen", "return_window": "30 days"}])
    told = ["--shipping", shipping, "--returns", returns]
    assert main(["answer", "--input", asked, "--output", str(tmp_path / "answers"), *told, "--vectors", str(tmp_path / "store"),
                 "--history", history, "--system-prompt", "sys", "--top-k", "3"]) == 0
    rows = {r["query_id"]: r for r in map(json.loads, lines_of(tmp_path / "answers"))}
    assert rows[1]["prompt"].count('"product_id"') == 3 and "Standard: 5 days" in rows[2]["policy_text"]
    (tmp_path / "arriving").mkdir()
    (tmp_path / "arriving" / "a.json").write_text((tmp_path / "asked.jsonl").read_text())
    assert main(["route", "--input", asked, "--output", str(tmp_path / "routed"), *told]) == 0
    assert main(["route", "--input", str(tmp_path / "arriving"), "--output", str(tmp_path / "streamed"), *told, "--stream"]) == 0
    batch = {(r["query_id"], r["route"]) for r in map(json.loads, lines_of(tmp_path / "routed"))}
    assert batch == {(r.query_id, r.route) for r in spark.read.parquet(str(tmp_path / "streamed")).collect()} == {(1, "search"), (2, "shipping")}


def test_dialogue_without_hits_in_both_forms(spark):
    from aislekit import vocabulary as V
    from aislekit.operators.chat import assemble_messages

    asked = spark.createDataFrame([(1, "any pot?", None)], "conv_id int, query string, product_context string")
    none = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    last = [assemble_messages(asked, none, "sys", listed).first().messages[-1].content for listed in (False, True)]
    assert last == [f"any pot?\n\n{V.NO_MATCH_INTRO}", f"any pot?\n\n{V.CONTEXT_INTRO}\n{V.NO_PRODUCTS}"]
