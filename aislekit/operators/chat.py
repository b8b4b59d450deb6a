"""Chat tables: validation, merging, conversations and prompts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aislekit import vocabulary as V

from aislekit.functions.chat import chat_fault
from aislekit.functions.text import is_blank

# Turns of a conversation that are put together by one task.
_TURNS_PER_PIECE = 256
# Parts of a file that are validated at first before it is asked whether more are needed; then so many times more.
_FIRST_WAVE, _GROWTH = 4, 4


def validate_chat(lines: DataFrame) -> DataFrame:
    """(line_no, ok, reason) for each line that is not blank; the reason is the first that applies."""
    checked = lines.where(~is_blank(F.col("line"))).select("line_no", chat_fault(F.col("line")).alias("reason"))
    return checked.select("line_no", F.col("reason").isNull().alias("ok"), F.coalesce("reason", F.lit("")).alias("reason"))


def first_errors(verdicts: DataFrame, max_errors: int = 20) -> DataFrame:
    """The report of the first failing lines, `L<line>: <reason>`."""
    worst = verdicts.where(~F.col("ok")).orderBy("line_no").limit(max_errors)
    return worst.select(
        "line_no", F.concat(F.lit("L"), F.col("line_no").cast("string"), F.lit(": "), F.col("reason")).alias("error")
    )


@dataclass
class Report:
    """What a validation has seen when it stops: rows checked and good, and (file, line number, reason) of the others."""

    total: int = 0
    ok: int = 0
    errors: list[tuple[str, int, str]] = field(default_factory=list)
    stopped: bool = False


def validate_until(spark: SparkSession, path: str | list[str], max_errors: int = 20) -> Report:
    """Check chat lines from the top until `max_errors` have failed, and read no further.

    Files come in the order of their names and their parts in the order of their lines, a few parts at first and
    ever more at a time. A part tells its counts and its first failing lines alone, so little reaches the driver. As
    a line that is no JSON is passed over before the errors are counted, the end is the first line that is JSON
    and has `max_errors` failing lines up to it; failing lines before it are all listed.
    """
    report = Report()
    for file in sorted(spark.read.text(path).inputFiles()):
        seen, at, wave = 0, 0, _FIRST_WAVE
        parts = _part_reports(spark.read.text(file), max_errors).rdd
        while at < parts.getNumPartitions() and not report.stopped:
            end = min(parts.getNumPartitions(), at + wave)
            for part in spark.sparkContext.runJob(parts, list, range(at, end)):
                if not report.stopped:
                    _add(report, part, file, seen, max_errors)
                    seen += part["lines"]
            at, wave = end, wave * _GROWTH
        if report.stopped:
            break
    return report


_STOP = "struct<line:bigint,total:bigint,ok:bigint,errors:bigint>"


def _part_reports(lines: DataFrame, max_errors: int) -> DataFrame:
    """One row for each part of a file: its `lines`, rows checked and good, its first failing lines (`errors`), and where
    a validation ends that lacks 0, 1, 2 … more failing lines when it comes here (`stops`, as far as that is in the part)."""
    judged = lines.select(is_blank(F.col("value")).alias("blank"), chat_fault(F.col("value")).alias("reason"))

    def run(batches):
        import pyarrow as pa

        n = total = ok = failed = 0
        errors, stops = [], []
        for batch in batches:
            for blank, reason in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n += 1
                if blank:
                    continue
                total, ok, failed = total + 1, ok + (reason is None), failed + (reason is not None)
                if reason is not None and len(stops) <= max_errors:
                    errors.append({"line": n, "reason": reason})
                if reason != V.BAD_JSON:
                    while len(stops) <= min(failed, max_errors):
                        stops.append({"line": n, "total": total, "ok": ok, "errors": failed})
        yield pa.RecordBatch.from_pylist(
            [{"lines": n, "total": total, "ok": ok, "errors": errors, "stops": stops}], pa.schema([
                ("lines", pa.int64()), ("total", pa.int64()), ("ok", pa.int64()),
                ("errors", pa.list_(pa.struct([("line", pa.int64()), ("reason", pa.string())]))),
                ("stops", pa.list_(pa.struct([(c, pa.int64()) for c in ("line", "total", "ok", "errors")])))]))

    return judged.mapInArrow(run, f"lines bigint, total bigint, ok bigint, errors array<struct<line:bigint,reason:string>>, stops array<{_STOP}>")


def _add(report: Report, part, file: str, seen: int, max_errors: int) -> None:
    lacking = max(0, max_errors - len(report.errors))
    end = part["stops"][lacking] if lacking < len(part["stops"]) else None
    report.stopped = end is not None
    report.total += (end or part)["total"]
    report.ok += (end or part)["ok"]
    report.errors += [(file, seen + e["line"], e["reason"]) for e in (part["errors"][:end["errors"]] if end else part["errors"])]


def validation_summary(verdicts: DataFrame) -> DataFrame:
    """One row: checked, good and bad rows."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("errors")
    )


def reasons_summary(verdicts: DataFrame) -> DataFrame:
    """Bad rows per reason."""
    return verdicts.where(~F.col("ok")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def merge_sets(**parts: DataFrame) -> DataFrame:
    """All rows of all parts, with the part's name as `source`."""
    named = [df.withColumn("source", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def reconcile(merged: DataFrame, *parts: DataFrame) -> DataFrame:
    """One row: rows of the parts, rows of the merged set, and `match` or `mismatch`."""
    counts = reduce(lambda a, b: a.unionAll(b), [p.agg(F.count(F.lit(1)).alias("n")) for p in parts])
    out = merged.agg(F.count(F.lit(1))).scalar()
    return counts.agg(F.sum("n").alias("part_rows")).select(
        "part_rows", out.alias("merged_rows"),
        F.when(F.col("part_rows") == out, "match").otherwise("mismatch").alias("verdict"),
    )


def reconcile_contents(merged: DataFrame, **parts: DataFrame) -> DataFrame:
    """(source, part_rows, merged_rows, verdict) for every part, and for sources of the merged set that are no part.

    Both sides have a fingerprint that order does not change and repeats do, sums of two row hashes, which are added up
    before any row is moved. `match` means the same rows as often; otherwise rows are `lost` or `added`, or as many
    are there but not the same ones, `changed`. Columns are told apart by name; a null is a value like others.
    """
    columns = [c for c in merged.columns if c != "source"]
    given = merge_sets(**parts).select("source", *columns).withColumn("side", F.lit(1))
    both = given.unionByName(merged.select("source", *columns).withColumn("side", F.lit(-1)))
    # null and default values hash alike in a row of columns, texts of rows do not
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    off = [F.sum((F.xxhash64(F.lit(seed), row).cast("decimal(38,0)") * F.col("side"))) for seed in (1, 2)]
    told = both.groupBy("source").agg(
        F.count_if(F.col("side") == 1).alias("part_rows"), F.count_if(F.col("side") == -1).alias("merged_rows"), *[o.alias(f"off_{i}") for i, o in enumerate(off)])
    verdict = (
        F.when(F.col("part_rows") > F.col("merged_rows"), "lost").when(F.col("part_rows") < F.col("merged_rows"), "added")
        .when((F.col("off_0") == 0) & (F.col("off_1") == 0), "match").otherwise("changed")
    )
    return told.select("source", "part_rows", "merged_rows", verdict.alias("verdict"))


def source_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): the turns of each conversation in order.

    Put together in pieces of 256 turns first, so a very long conversation is sorted by
    many tasks; only its finished pieces meet in one row.
    """
    message = F.struct(F.col("role"), F.col("text").alias("content"))
    piece = F.floor(F.col("turn") / _TURNS_PER_PIECE).alias("piece")
    pieces = turns.groupBy("conv_id", piece).agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn"), message.alias("message")))).alias("entries")
    )
    ordered = F.array_sort(F.collect_list(F.struct(
        F.col("piece"), F.transform("entries", lambda e: e["message"]).alias("messages")
    )))
    return pieces.groupBy("conv_id").agg(
        F.flatten(F.transform(ordered, lambda p: p["messages"])).alias("messages")
    )


def prompt_of(messages: Column) -> Column:
    """The prompt text of messages; other roles are skipped, the last tag is left open."""
    known = F.filter(messages, lambda m: m["role"].isin("system", "user", "assistant"))
    tagged = F.transform(
        known, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), F.coalesce(m["content"], F.lit("")), F.lit("\n"))
    )
    return F.concat(F.array_join(tagged, ""), F.lit("<|assistant|>\n"))


def format_prompt(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt) from a table of turns."""
    return conversations(turns).select("conv_id", prompt_of(F.col("messages")).alias("prompt"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def assemble_messages(queries: DataFrame, history: DataFrame, system_prompt: str, always_listed: bool = False) -> DataFrame:
    """The queries with `messages`: system prompt, past turns with content, then the query itself.

    `queries` holds conv_id, query and the `product_context` text (null when nothing was found). The
    streamed dialogue then says so in place of a list; the other one (`always_listed`) introduces a
    list that says so.
    """
    if always_listed:
        queries = queries.withColumn("product_context", F.coalesce("product_context", F.lit(V.NO_PRODUCTS)))
    past = conversations(history.where((F.length("text") > 0) & F.col("role").isin("user", "assistant")))
    joined = queries.join(past.withColumnRenamed("messages", "past"), "conv_id", "left")
    return joined.withColumn("messages", messages_after(F.col("past"), system_prompt)).drop("past")


def messages_after(past: Column, system_prompt: str) -> Column:
    """System prompt, past messages and the question of a row with `query` and `product_context`."""
    asked = F.when(
        F.col("product_context").isNotNull(),
        F.concat(F.col("query"), F.lit(f"\n\n{V.CONTEXT_INTRO}\n"), F.col("product_context")),
    ).otherwise(F.concat(F.col("query"), F.lit(f"\n\n{V.NO_MATCH_INTRO}")))
    none = F.array().cast("array<struct<role: string, content: string>>")
    return F.concat(
        F.array(_message("system", F.lit(system_prompt))),
        F.coalesce(past, none),
        F.array(_message("user", asked)),
    )
