"""Chat rows, conversations, prompts, retrieval and streaming."""

import json
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aislekit import vocabulary as V
from aislekit.operators import cells, chat as O, replies, retrieval
from aislekit.sources import vectors
from aislekit.streaming import router


def row(*messages):
    return json.dumps({"messages": [dict(role=r, content=c) for r, c in messages]})


GOOD = [("system", "s"), ("user", "u"), ("assistant", "a")]
CASES = [
    ("{bad", V.BAD_JSON),
    ("[1]", V.NOT_OBJECT),
    ("null", V.NOT_OBJECT),
    ('{"messages":"x"}', V.NO_MESSAGES),
    ("{}", V.NO_MESSAGES),
    (row(*GOOD[:2]), V.TOO_SHORT),
    (row(("user", "u"), ("assistant", "a"), ("user", "u")), V.WRONG_ROLES),
    (row(*GOOD, ("user", 5)), "Message 3 missing string role/content"),
    (row(("system", "s"), ("user", " \n "), ("assistant", "a")), "Message 1 content is empty"),
    (row(("system", ""), ("user", 7), ("assistant", "a")), "Message 0 content is empty"),
    (row(*GOOD, (None, "x")), "Message 3 missing string role/content"),
    ('{"messages":[{"role":"system","content":"s"},{"role":"user","content":"u"},{"role":"assistant","content":"a"},3]}',
     "Message 3 missing string role/content"),
    (row(*GOOD), ""),
    (row(*GOOD, ("tool", "x")), ""),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    lines = [(i * 2 + 1, line) for i, (line, _) in enumerate(CASES)] + [(2, "  "), (4, "")]
    return O.validate_chat(spark.createDataFrame(lines, "line_no bigint, line string"))


def test_chat_reasons(verdicts):
    got = {r.line_no: (r.ok, r.reason) for r in verdicts.collect()}
    assert got == {i * 2 + 1: (reason == "", reason) for i, (_, reason) in enumerate(CASES)}


def test_chat_reports(verdicts):
    assert tuple(O.validation_summary(verdicts).collect()[0]) == (len(CASES), 2, len(CASES) - 2)
    first = O.first_errors(verdicts, 3).collect()
    assert [r.line_no for r in first] == [1, 3, 5] and first[0].error == f"L1: {V.BAD_JSON}"


def test_long_conversation_stays_in_order(spark):
    """One conversation holds most turns, many pieces long."""
    turns = spark.range(3000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"),
    ).unionByName(spark.createDataFrame([(2, 0, "tool", "x"), (3, 0, "system", "y")], "conv_id int, turn bigint, role string, text string"))
    got = {r.conv_id: r.prompt for r in O.format_prompt(turns.repartition(7)).collect()}
    whole = "".join(f"<|{'user' if i % 2 == 0 else 'assistant'}|>\n{i}\n" for i in range(3000))
    assert got == {1: whole + "<|assistant|>\n", 2: "<|assistant|>\n", 3: "<|system|>\ny\n<|assistant|>\n"}


def test_messages_with_and_without_history(spark):
    queries = spark.createDataFrame([(1, "q1", "found"), (2, "q2", None)], "conv_id int, query string, product_context string")
    history = spark.createDataFrame(
        [(1, 0, "system", "no"), (1, 1, "user", "u"), (1, 2, "assistant", ""), (1, 3, "assistant", "a")],
        "conv_id int, turn int, role string, text string",
    )
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in O.assemble_messages(queries, history, "sys").collect()}
    assert got[1] == [("system", "sys"), ("user", "u"), ("assistant", "a"), ("user", f"q1\n\n{V.CONTEXT_INTRO}\nfound")]
    assert got[2] == [("system", "sys"), ("user", f"q2\n\n{V.NO_MATCH_INTRO}")]


def test_reconcile(spark):
    a, b = spark.range(3), spark.range(4)
    merged = O.merge_sets(a=a, b=b)
    assert tuple(O.reconcile(merged, a, b).collect()[0]) == (7, 7, "match")
    assert tuple(O.reconcile(merged.limit(5), a, b).collect()[0]) == (7, 5, "mismatch")
    assert {tuple(r) for r in O.source_counts(merged).collect()} == {("a", 3), ("b", 4)}


def test_lines_that_are_no_strict_json_are_judged_like_others(spark):
    good = '"messages":[{"role":"system","content":"a"},{"role":"user","content":"b"},{"role":"assistant","content":"%s"}]}'
    lines = [
        '{"k":1,"k":2,' + good % "c", '{"k":NaN,' + good % "c", '{"k":NaN,' + good % " ", '{"k":Infinity,"messages":3}', '{"k":1,"k":2,"messages":[]}',
        '{"messages":[1],' + good % "c", '{"k":1,"k":2', "[NaN]", '{"k":NaN,"messages":[{"role":"user"},{},{}]}', '{' + good % ("x" * 20_000_000),
    ]
    got = [r.reason for r in O.validate_chat(spark.createDataFrame(list(enumerate(lines, 1)), "line_no bigint, line string")).orderBy("line_no").collect()]
    assert got == [
        "", "", "Message 2 content is empty", V.NO_MESSAGES, V.TOO_SHORT, "", V.BAD_JSON, V.NOT_OBJECT, V.WRONG_ROLES, "",
    ]


@pytest.mark.parametrize("chunk_rows", [7, 50, 4096])
def test_search_equals_brute_force(spark, chunk_rows):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(200, 12)), 2).astype("float32")
    vectors[10] = vectors[3]
    vectors[11] = vectors[3] * 2  # the same direction: a tie
    vectors[20] = 0
    queries = np.vstack([vectors[3], np.zeros(12), rng.normal(size=(28, 12))]).astype("float32")
    v = spark.createDataFrame([(f"p{i:03d}", x.tolist()) for i, x in enumerate(vectors)], "product_id string, embedding array<float>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "query_id int, embedding array<float>")

    def unit(m):
        m = m.astype("float64")
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = np.round(unit(queries) @ unit(vectors).T, 9)
    want = {
        (i, r + 1): (f"p{j:03d}", pytest.approx(scores[i, j], abs=1e-8))
        for i in range(30) for r, j in enumerate(sorted(range(200), key=lambda j: (-scores[i, j], j))[:8])
    }
    got = {(r.query_id, r.rank): (r.product_id, r.score) for r in retrieval.search(q, v, chunk_rows=chunk_rows).collect()}
    assert got == want
    assert [got[0, r][0] for r in (1, 2, 3)] == ["p003", "p010", "p011"]
    few = retrieval.search(q, v.limit(3), chunk_rows=chunk_rows)
    assert few.count() == 90
    above = retrieval.search(q, v, threshold=0.5, chunk_rows=chunk_rows)
    assert {(r.query_id, r.rank) for r in above.collect()} == {k for k, (_, s) in got.items() if s >= 0.5}


def test_search_passes_over_vectors_that_cannot_be_compared(spark):
    nan = float("nan")
    v = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [nan, 1.0]), ("e", []), ("f", [None, 1.0]), ("g", [0.0, 2.0])],
        "product_id string, embedding array<float>",
    )
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [5.0])], "query_id int, embedding array<float>")
    got = {(r.query_id, r.rank): (r.product_id, r.score) for r in retrieval.search(q, v).collect()}
    assert got == {(1, 1): ("a", 1.0), (1, 2): ("g", 0.0), (3, 1): ("c", 1.0)}


def test_no_query_vector_reaches_the_driver(spark, monkeypatch):
    """Many chunks, and one query id that a third of the rows share: the plan stays the same, and of what is asked nothing
    is collected, of what is offered only the references."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    ids = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("query_id")
    q = spark.range(0, 300, 1, 3).select(ids, F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    v = spark.range(40).select(F.concat(F.lit("p"), "id").alias("product_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))

    def guarded(original):
        def read(df, *a, **kw):
            out = original(df, *a, **kw)
            assert "query_id" not in df.columns and "vector" not in df.columns
            assert "embedding" not in df.columns or len(out) <= 40 ** 0.5
            return out

        return read

    with monkeypatch.context() as m:
        for name in ("toArrow", "toPandas", "collect", "toLocalIterator"):
            m.setattr(Classic, name, guarded(getattr(Classic, name)))
        found = {rows: retrieval.search(q, v, chunk_rows=rows) for rows in (5, 4096)}
        plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in found.values()]
    assert [p.count("Relation [") for p in plans] == [3, 3]  # what is found near, visits and vectors
    got = [{(r.query_id, r.rank): (r.product_id, r.score) for r in f.collect()} for f in found.values()]
    assert got[0] == got[1] and len(got[0]) == 201 * 8


def clustered(spark, rows, seed=1, clusters=40, numbers=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, numbers))
    x = (centres[rng.integers(0, clusters, rows)] + 0.15 * rng.normal(size=(rows, numbers))).astype("float32")
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "product_id bigint, embedding array<float>")


def test_cells_spare_most_pairs_of_clustered_vectors(spark, tmp_path):
    x, v = clustered(spark, 4000)
    q = v.where("product_id % 10 = 0").withColumnRenamed("product_id", "query_id")
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    best = -np.sort(-(u[::10] @ u.T), axis=1)[:, :8]
    vectors.write_vectors(v, str(tmp_path / "store"))
    for offered in (v, vectors.open_vectors(spark, str(tmp_path / "store"))):
        compared = spark.sparkContext.accumulator(0)
        rows = retrieval.search(q, offered, compared=compared).orderBy("query_id", "rank").collect()
        assert np.allclose(np.array([r.score for r in rows]).reshape(400, 8), best, atol=1e-8)
        assert 0 < compared.value < 0.25 * 400 * 4000
    # a threshold is a bar from the start
    compared = spark.sparkContext.accumulator(0)
    above = retrieval.search(q, v, threshold=0.97, compared=compared).count()
    assert above == (best >= 0.97).sum() and compared.value < 0.25 * 400 * 4000


def test_bounds_hold_for_every_vector(spark):
    x, v = clustered(spark, 600, seed=2)
    references = cells.references_of(v, "product_id")
    rows = cells.assigned(v, references).collect()
    table = {r["cell"]: (r["low"], r["high"], r["rows"]) for r in cells.cell_table(cells.assigned(v, references)).collect()}
    known = cells.Cells(references, table)
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    numbers, bound = known.bounds(32, u)
    place = {c: i for i, c in enumerate(numbers.tolist())}
    for r in rows:
        assert (u @ u[r["product_id"]] <= bound[:, place[r["cell"]]] + 1e-9).all()
    assert sorted(known.in_order()) == sorted(table)


def test_a_cell_of_equal_vectors_lies_on_several_shelves(spark, monkeypatch):
    """A third of the vectors are equal; the lowest ids win, wherever they lie."""
    x, v = clustered(spark, 900, seed=3, numbers=6)
    v = v.select("product_id", F.when(F.col("product_id") % 3 == 0, F.array(*[F.lit(float(n)) for n in range(6)])).otherwise(F.col("embedding").cast("array<double>")).alias("embedding"))
    monkeypatch.setattr(retrieval, "_SHELF_BYTES", 64 * 6 * 8)
    monkeypatch.setattr(retrieval, "_PART_ROWS", 100)
    q = v.withColumnRenamed("product_id", "query_id")
    rows = retrieval.search(q, v, k=5, chunk_rows=64).where("query_id = 3").orderBy("rank").collect()
    assert [r.product_id for r in rows] == [0, 3, 6, 9, 12] and {r.score for r in rows} == {1.0}


def test_a_batch_of_queries_visits_all_cells_in_little_memory():
    """Without clusters every query visits every cell; bounds and lists are made for a few queries at a time."""
    rng = np.random.default_rng(5)
    n, size = 2_000, 16
    units = rng.normal(size=(512, size))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    known = cells.Cells(cells.References({size: (np.arange(512), units)}), {c: (0.0, 3.0, 40) for c in range(512)})
    shelves = retrieval.Shelves.of(known, "float", 4)
    batch = pa.RecordBatch.from_pydict({
        "row": np.arange(n), "query_id": np.arange(n), "vector": list(rng.normal(size=(n, size)).astype("float32")),
        "home": np.arange(n) % 512, "bar": np.full(n, 0.5)})
    asked = SimpleNamespace(
        schema={c: SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "any")) for c in ("query_id", "vector")},
        mapInArrow=lambda run, schema: run)
    visits, seen = retrieval._visits(asked, known, shelves, False), set()
    pairs = 0
    tracemalloc.start()
    for out in visits(iter([batch])):
        pairs += len(out.column("cells").flatten())
        seen.update(zip(out.column("row").to_pylist()[:50], out.column("shelf").to_pylist()[:50]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a query leaves out its own cell on the shelf that it visited first
    assert pairs == n * (sum(count for _, count in shelves.spans.values()) - 1) and seen
    assert peak < 30 << 20


def test_near_ties_are_ranked_by_their_score(spark):
    """Scores that round to the same nine digits."""
    v = spark.createDataFrame([("a", [1.0, 2e-5]), ("b", [1.0, 1e-5])], "product_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [r.product_id for r in retrieval.search(q, v).orderBy("rank").collect()] == ["b", "a"]


def test_search_over_nothing(spark):
    q = spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<float>")
    v = spark.createDataFrame([], "product_id string, embedding array<float>")
    assert retrieval.search(q, v).count() == 0


QUERIES = [
    (1, "How long does shipping take for health products?", "shipping", "Health_and_Household"),
    (2, "What's the return policy for tools?", "returns", "Tools_and_Home_Improvement"),
    (3, "retail food price", "shipping", "Home_and_Kitchen"),
    (4, "ship or refund?", "shipping", "Home_and_Kitchen"),
    (5, "Find organic snacks", "search", "Grocery_and_Gourmet_Food"),
    (6, None, "search", "Home_and_Kitchen"),
    (7, "", "search", "Home_and_Kitchen"),
    (8, "CAN I RETURN a painting", "returns", "Arts_Crafts_and_Sewing"),
]
SHIPPING = [(1, "Health_and_Household", "9", "2", "1", "0", "5", "20"), (2, "Health_and_Household", "5", None, "1", "0", "7", "25")]
RETURNS = [(1, "Tools_and_Home_Improvement", "30 days", "New", "5", None)]


@pytest.fixture(scope="module")
def policies(spark):
    from aislekit import schemas

    return spark.createDataFrame(SHIPPING, schemas.SHIPPING), spark.createDataFrame(RETURNS, schemas.RETURNS)


def test_policy_lookup(spark, policies):
    df = spark.createDataFrame([q[:2] for q in QUERIES], "query_id int, user_query string")
    got = {r.query_id: r for r in replies.policy_lookup(df, *policies).collect()}
    assert {(i, r.route, r.category) for i, r in got.items()} == {(q[0], q[2], q[3]) for q in QUERIES}
    assert got[1].policy_text == (
        "Shipping options:\n- Standard: 5 days (free)\n- Express: None days ($7)\n- Overnight: 1 days ($25)"
    )
    assert got[2].policy_text == (
        "Return policy:\n- Return window: 30 days\n- Condition: New\n- Restocking fee: $5\n- Special notes: None"
    )
    assert got[3].policy_text == "Shipping information not available for Home_and_Kitchen."
    assert got[8].policy_text == "Return policy not available for Arts_Crafts_and_Sewing."
    assert got[5].policy_text is None


def test_stream_equals_batch_over_restarts(spark, policies, tmp_path):
    df = spark.createDataFrame([q[:2] for q in QUERIES], "query_id int, user_query string")
    source, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    for part in (df.where("query_id < 4"), df.where("query_id >= 4")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        router.write_stream(router.route_stream(stream, *policies), out, offsets).awaitTermination()
    batch = replies.policy_lookup(df, *policies)
    streamed = spark.read.parquet(out).select(*batch.columns)
    assert sorted(streamed.collect(), key=lambda r: r.query_id) == sorted(batch.collect(), key=lambda r: r.query_id)
