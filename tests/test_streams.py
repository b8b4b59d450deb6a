"""Dialogue streams and validations that stop early."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from aislekit import vocabulary as V
from aislekit.operators import chat as O
from aislekit.streaming import dialogue, metrics, router

TURN = "conv_id bigint, turn int, role string, text string, at timestamp, asks boolean, product_context string"


def good(i):
    return json.dumps({"messages": [dict(role=r, content=f"{r}{i}") for r in ("system", "user", "assistant")]})


def arrive(spark, folder, rows):
    """Rows (conv_id, turn, role, text, minute, asks) as one more file."""
    df = spark.createDataFrame([(c, t, r, x, m, a, None) for c, t, r, x, m, a in rows], TURN.replace("at timestamp", "minute int"))
    df.withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("minute") * 60)).select(*[c.split(" ")[0] for c in TURN.split(", ")]).coalesce(1).write.mode("append").parquet(folder)


def answers(spark, folder, out, **kw):
    stream = dialogue.stream_messages(spark.readStream.schema(TURN).parquet(folder), "sys", **kw)
    router.write_stream(stream, out, out + "-offsets").awaitTermination()
    return {(r.conv_id, r.turn): [m.content for m in r.messages] for r in spark.read.parquet(out).collect()}


def asked(text):
    return f"{text}\n\n{V.NO_MATCH_INTRO}"


def test_history_is_kept_across_restarts(spark, tmp_path):
    folder, out = str(tmp_path / "turns"), str(tmp_path / "out")
    arrive(spark, folder, [(1, 2, "user", "q2", 2, True), (1, 0, "user", "a", 0, False), (1, 1, "assistant", "b", 1, False), (2, 0, "user", "x", 0, True), (None, 0, "user", "n", 0, True)])
    assert answers(spark, folder, out) == {(1, 2): ["sys", "a", "b", asked("q2")], (2, 0): ["sys", asked("x")], (None, 0): ["sys", asked("n")]}
    arrive(spark, folder, [(1, 3, "assistant", "c", 3, False), (1, 4, "system", "no", 3, False), (1, 5, "user", "", 3, False), (1, 6, "user", "q6", 4, True), (2, 1, "user", "y", 4, True)])
    found = answers(spark, folder, out)
    assert found[1, 6] == ["sys", "a", "b", "q2", "c", asked("q6")] and found[2, 1] == ["sys", "x", asked("y")] and len(found) == 5
    assert answers(spark, folder, out) == found


def test_turns_that_come_late(spark, tmp_path):
    folder, out = str(tmp_path / "turns"), str(tmp_path / "out")
    arrive(spark, folder, [(1, 0, "user", "a", 100, False), (1, 4, "user", "q4", 101, True)])
    answers(spark, folder, out)
    # within the allowance: the answer stays, later ones know the turn
    arrive(spark, folder, [(1, 2, "assistant", "late", 95, False)])
    answers(spark, folder, out)
    # beyond it: dropped
    arrive(spark, folder, [(1, 3, "assistant", "too late", 10, False), (1, 6, "user", "q6", 102, True)])
    found = answers(spark, folder, out)
    assert found == {(1, 4): ["sys", "a", asked("q4")], (1, 6): ["sys", "a", "late", "q4", asked("q6")]}


def test_idle_conversations_are_forgotten(spark, tmp_path):
    folder, out = str(tmp_path / "turns"), str(tmp_path / "out")
    hour = dict(idle_ms=3600 * 1000)
    arrive(spark, folder, [(1, 0, "user", "a", 0, False), (2, 0, "user", "b", 0, False)])
    answers(spark, folder, out, **hour)
    arrive(spark, folder, [(2, 1, "assistant", "c", 300, False)])
    answers(spark, folder, out, **hour)
    arrive(spark, folder, [(1, 1, "user", "q", 301, True), (2, 2, "user", "q", 301, True)])
    found = answers(spark, folder, out, **hour)
    assert found[1, 1] == ["sys", asked("q")] and found[2, 2][-2:] == ["c", asked("q")]


def brute_report(files, most):
    total = ok = 0
    errors = []
    for name, lines in files:
        for n, line in enumerate(lines, 1):
            if not line.strip():
                continue
            total += 1
            try:
                json.loads(line)
            except ValueError:
                errors.append((name, n))
                continue
            if line == "[1]":
                errors.append((name, n))
            else:
                ok += 1
            if len(errors) >= most:
                return total, ok, errors, True
    return total, ok, errors, False


@pytest.mark.parametrize("most", [0, 1, 3, 20, 1000])
def test_validation_stops_where_it_should(spark, tmp_path, most):
    files = []
    for f in range(3):
        lines = [("{bad" if i % 7 == f else "[1]" if i % 11 == 3 else "" if i % 5 == 0 else good(i)) for i in range(80)]
        files.append((f"f{f}.jsonl", lines))
        (tmp_path / f"f{f}.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        report = O.validate_until(spark, str(tmp_path), most)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = [(file.rsplit("/", 1)[1], n) for file, n, _ in report.errors]
    assert (report.total, report.ok, found, report.stopped) == brute_report(files, most)


def test_later_parts_are_not_read(spark, tmp_path, monkeypatch):
    (tmp_path / "a.jsonl").write_text("".join(("[1]" if i % 9 == 0 else good(i)) + "\n" for i in range(4000)))
    whole = gzip.compress(good(1).encode() * 500)
    (tmp_path / "b.jsonl.gz").write_bytes(whole[:len(whole) // 2])  # would fail if it were read
    asked_for, run = [], type(spark.sparkContext).runJob
    monkeypatch.setattr(type(spark.sparkContext), "runJob", lambda sc, rdd, f, parts: asked_for.append((len(parts), rdd.getNumPartitions())) or run(sc, rdd, f, parts))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        report = O.validate_until(spark, str(tmp_path), 30)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert report.stopped and len(report.errors) == 30 and report.total == 29 * 9 + 1
    assert sum(n for n, _ in asked_for) < asked_for[0][1] / 2 and len(asked_for) >= 2


def test_contents_tell_lost_doubled_and_swapped_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "")], "id int, text string")
    b = spark.createDataFrame([(7, "p"), (8, "q")], "id int, text string")
    merged = O.merge_sets(a=a, b=b)

    def told(df):
        return {r.source: r.verdict for r in O.reconcile_contents(df, a=a, b=b).collect()}

    assert told(merged.orderBy(F.rand(1))) == {"a": "match", "b": "match"}
    assert told(merged.where("id != 8")) == {"a": "match", "b": "lost"}
    assert told(merged.union(merged.where("id = 7"))) == {"a": "match", "b": "added"}
    assert told(merged.where("id != 8").union(merged.where("id = 7"))) == {"a": "match", "b": "changed"}
    assert told(merged.fillna("", "text")) == {"a": "changed", "b": "match"}
    assert told(merged.replace({"a": "b", "b": "a"}, subset=["source"])) == {"a": "lost", "b": "added"}


RESULT = "test_id bigint, response_time double, at timestamp, evaluation struct<query_type:string,is_accurate:boolean,is_empty:boolean,contains_error:boolean,error:boolean>"


def counted(spark, tmp_path, rows):
    folder, out = str(tmp_path / "results"), str(tmp_path / "counts")
    df = spark.createDataFrame([(i, t, m, *e) for i, t, m, e in rows], "test_id bigint, response_time double, minute int, q string, a boolean, m boolean, c boolean, e boolean")
    evaluation = F.struct(F.col("q").alias("query_type"), F.col("a").alias("is_accurate"), F.col("m").alias("is_empty"), F.col("c").alias("contains_error"), F.col("e").alias("error"))
    df.select("test_id", "response_time", F.timestamp_seconds(1_700_000_000 + F.col("minute") * 60).alias("at"), evaluation.alias("evaluation")).coalesce(1).write.mode("append").parquet(folder)
    stream = metrics.stream_counts(spark.readStream.schema(RESULT).parquet(folder), late="30 minutes")
    metrics.write_counts(stream, out, out + "-offsets").awaitTermination()
    return metrics.counted_metrics(spark, out).first()


def test_metrics_of_arriving_runs(spark, tmp_path):
    good, bad, failed = ("price", True, False, False, False), ("price", False, True, True, False), (None, None, None, None, True)
    first = counted(spark, tmp_path, [(1, 1.0, 0, good), (2, 50.0, 1, bad), (1, 9.0, 2, bad)])  # 1 comes twice
    assert (first.total_tests, first.successful_tests, first.query_type_accuracy["price"], first.avg_response_time) in ((2, 2, 0.5, 25.5), (2, 2, 0.0, 29.5))
    then = counted(spark, tmp_path, [(3, 0.0, 90, failed), (2, 50.0, 3, bad)])  # 2 comes again
    assert (then.total_tests, then.successful_tests, then.success_rate) == (3, 2, pytest.approx(2 / 3))
    assert then.query_type_accuracy["unknown"] == 0.0
    # 4 comes later than the watermark allows
    last = counted(spark, tmp_path, [(4, 1.0, 5, good), (5, 2.0, 91, good)])
    assert last.total_tests == 4 and last.successful_tests == 3
