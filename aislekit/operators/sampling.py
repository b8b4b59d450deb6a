"""Exact random samples, quotas and splits that scale with the table.

A sample of n rows is the n rows with the lowest digests. Sorting all rows for that would
end in one task, so the n-th digest is found first, from the key columns alone:

1. count rows per leading digits of the digest (65,536 buckets at most per group),
2. look into the one bucket in which the n-th row lies, at four more digits, until it is small,
3. rank the digests of that bucket.

The sample itself is then a plain filter on the full rows, without a shuffle. The n-th
digest of each group, five at most, is read by the driver when a sample is asked for.

Keys should tell rows apart, as row positions do. Copies that share a key also share a
digest; a sample or split still has exactly its number of rows then: at the cut, a second
digest of the whole row tells copies apart, and rows equal in all columns are numbered where they
are. No row is made anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from aislekit import vocabulary as V
from aislekit.functions.draws import digest
from aislekit.functions.text import is_blank
from aislekit.session import written

_BUCKET_DIGITS = 4
# Digests that are ranked in one task; a bucket with more rows is looked into once more.
_RANKED = 65_536
_DIGITS = 32
# A row as text: nulls are marked, times have their microseconds.
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_EXACT = {"ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": _TIME, "timestampNTZFormat": _TIME}
# Rows that a reservoir waits for before it is cut again, and the groups in which reservoirs are merged, one step after the other.
_HELD_ROWS, _MERGES = 4096, (256, 16, 1)
# Of an increasing id, the bits that number a row within its part.
_PART_BITS = 33


def _running(n: str, order: str, by: list[str]) -> Column:
    return F.sum(n).over(W.partitionBy(*by).orderBy(order))


def _reaching(counts: DataFrame, by: list[str], order: str, wanted: Column) -> DataFrame:
    """The one row per group with which the running count reaches the wanted rows."""
    counts = counts.withColumn("upto", _running("n", order, by)).withColumn("wanted", wanted)
    return counts.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))


def _cuts(keys: DataFrame, by: list[str], rows: int | None = None, share: float | None = None) -> list[Row]:
    """The last digest of each group's sample, with the rows that have it (`n`) and that fit (`take`).

    A group that is taken whole has no cut. `keys` holds the group columns and `drawn`. The driver
    reads one row per group and step; there are two steps unless a group has billions of rows.
    """
    digits = _BUCKET_DIGITS
    counts = keys.groupBy(*by, F.substring("drawn", 1, digits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*by))
    wanted = F.lit(rows) if share is None else F.ceil(total * F.lit(share))
    left = (F.col("wanted") - F.col("upto") + F.col("n")).alias("left")
    edges = _reaching(counts, by, "bucket", wanted).select(*by, "bucket", "n", left).collect()
    while edges:
        # One row per group, and the groups are the five target categories or the whole table.
        spark = keys.sparkSession
        known = F.broadcast(spark.createDataFrame(edges, keys.select(*by, F.lit("").alias("bucket"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("left")).schema))
        near = keys.withColumn("bucket", F.substring("drawn", 1, digits)).join(known.drop("n"), [*by, "bucket"])
        if digits == _DIGITS or max(e["n"] for e in edges) <= _RANKED:
            digests = near.groupBy(*by, "drawn", "left").agg(F.count(F.lit(1)).alias("n"))
            last = _reaching(digests, by, "drawn", F.col("left"))
            return last.select(*by, "drawn", "n", (F.col("left") - F.col("upto") + F.col("n")).alias("take")).collect()
        digits += _BUCKET_DIGITS
        counts = near.groupBy(*by, F.substring("drawn", 1, digits).alias("bucket"), "left").agg(F.count(F.lit(1)).alias("n"))
        edges = _reaching(counts, by, "bucket", F.col("left")).select(
            *by, "bucket", "n", (F.col("left") - F.col("upto") + F.col("n")).alias("left")).collect()
    return []


def _of_group(df: DataFrame, cut: Row, by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [df[c] == cut[c] for c in by], F.lit(True))


def _unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _marked(df: DataFrame, drawn: Column, cuts: list[Row], by: list[str], seed: int, tie: list[str] | None = None) -> DataFrame:
    """All rows with one more column, the last, which tells whether they are up to the cut of their group.

    Of the copies at a cut of which only some fit, a second digest of the `tie` columns chooses, then one of the
    whole row. Rows that share this one too are written, numbered in place, and the first of them chosen.
    """
    chosen = F.lit(True)
    for cut in cuts:
        fits = (drawn <= cut["drawn"]) if cut["n"] == cut["take"] else (drawn < cut["drawn"])
        chosen = F.when(_of_group(df, cut, by), fits).otherwise(chosen)
    levels = [digest(seed, "copies", *(F.col(c) for c in tie))] if tie else []
    levels.append(digest(seed, "copies", F.to_json(F.struct(*df.columns), _EXACT)))
    equal = []
    for cut in cuts:
        same, n, take = _of_group(df, cut, by) & (drawn == cut["drawn"]), cut["n"], cut["take"]
        for level in levels:
            if n > take:
                inner = _cuts(df.where(same).select(level.alias("drawn")), [], rows=take)[0]
                n, take = inner["n"], inner["take"]
                chosen = F.when(same, level < inner["drawn"] if n > take else level <= inner["drawn"]).otherwise(chosen)
                same = same & (level == inner["drawn"])
        if n > take:
            equal.append((same, take))
    out = df
    for same, _ in equal:
        out = out.where(~F.coalesce(same, F.lit(False)))
    mark, copy = _unused(df, "chosen"), _unused(df, "copy")
    out = out.withColumn(mark, chosen)
    for same, take in equal:
        rows = written(df.where(same).withColumn(copy, F.monotonically_increasing_id()), "equal-rows")
        # An id is the number of its part, then of the row in it: one row per part is read to find the part of the last one.
        parts = rows.groupBy(F.shiftright(copy, _PART_BITS).alias("part")).agg(F.count(F.lit(1)).alias("n"))
        last = _reaching(parts, [], "part", F.lit(take)).select("part", (F.col("wanted") - F.col("upto") + F.col("n")).alias("left")).first()
        end = (last["part"] << _PART_BITS) + last["left"]
        out = out.unionAll(rows.select(*df.columns, (F.col(copy) < F.lit(end)).alias(mark)))
    return out


def _sampled(df: DataFrame, drawn: Column, cuts: list[Row], by: list[str], seed: int) -> DataFrame:
    """The rows up to the cuts of their groups."""
    marked = _marked(df, drawn, cuts, by, seed)
    return marked.where(F.col(marked.columns[-1])).select(*df.columns)


def _digest_of(df: DataFrame, key: str | list[str], seed: int, salt: str) -> Column:
    return digest(seed, salt, *[df[k] for k in ([key] if isinstance(key, str) else key)])


def sample_n(df: DataFrame, n: int, seed: int, key: str | list[str]) -> DataFrame:
    """A simple random sample of exactly min(n, rows) rows."""
    if n <= 0:
        return df.limit(0)
    drawn = _digest_of(df, key, seed, "sample")
    return _sampled(df, drawn, _cuts(df.select(drawn.alias("drawn")), [], rows=n), [], seed)


def reservoir_sample(lines: DataFrame, n: int, seed: int, key: str | list[str], text: str = "line") -> DataFrame:
    """A simple random sample of min(n, lines) of the lines that are not blank, in one pass over them.

    The lines of the n lowest digests, as `sample_n` takes them. Each task keeps a reservoir of n rows; reservoirs are
    merged like a tree, some of them in a task, so that no task sees them all unless they are few.
    """
    if n <= 0:
        return lines.limit(0)
    kept = lines.where(~is_blank(F.col(text)))
    order, copies = _unused(lines, "drawn"), _unused(lines, "copies")
    kept = kept.withColumns({order: _digest_of(kept, key, seed, "sample"), copies: digest(seed, "copies", F.to_json(F.struct(*lines.columns), _EXACT))})
    schema, lowest = kept.schema, _lowest(n, order, copies)
    kept = kept.mapInArrow(lowest, schema)
    for groups in _MERGES:
        kept = kept.repartition(F.spark_partition_id() % groups).mapInArrow(lowest, schema)
    return kept.select(*lines.columns)


def _lowest(n: int, *order: str):
    """The n rows of a task that are the lowest in `order`."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute

        def cut(parts):
            table = pa.Table.from_batches(parts) if isinstance(parts[0], pa.RecordBatch) else pa.concat_tables(parts)
            keep = pa.compute.select_k_unstable(table, n, [(c, "ascending") for c in order]) if len(table) > n else None
            return table if keep is None else table.take(keep).combine_chunks()

        held, waiting, rows = None, [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= max(n, _HELD_ROWS):
                new = cut(waiting)
                held, waiting, rows = cut([held, new]) if held is not None else new, [], 0
        if waiting:
            new = cut(waiting)
            held = cut([held, new]) if held is not None else new
        if held is not None:
            yield from held.to_batches()

    return run


def quota_sample(products: DataFrame, max_rows: int, seed: int, key: str = "product_id") -> DataFrame:
    """Up to max_rows // 5 random products of each target category."""
    quota = max_rows // len(V.TARGET_CATEGORIES)
    if quota <= 0:
        return products.limit(0)
    known = products.where(F.col("category").isin(V.TARGET_CATEGORIES))
    drawn = _digest_of(known, key, seed, "quota")
    cuts = _cuts(known.select("category", drawn.alias("drawn")), ["category"], rows=quota)
    return _sampled(known, drawn, cuts, ["category"], seed)


def merge_quota(kept: DataFrame, new: DataFrame, max_rows: int, seed: int, key: str = "product_id") -> DataFrame:
    """The quota sample of all products, from the one of earlier products and the products that are new.

    A product whose digest is above the last one of its category's full quota cannot be in any later sample, so most new
    rows are dropped where they are read: the driver reads one digest per category. Increments in any order
    give the sample of everything at once.
    """
    quota = max_rows // len(V.TARGET_CATEGORIES)
    if quota <= 0:
        return new.limit(0)
    drawn = _digest_of(kept, key, seed, "quota")
    held = kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.max(drawn).alias("last")).where(F.col("n") >= quota).collect()
    drawn = _digest_of(new, key, seed, "quota")
    chance = reduce(lambda a, r: F.when(new["category"] == r["category"], drawn <= r["last"]).otherwise(a), held, F.lit(True))
    return quota_sample(kept.unionByName(new.where(chance)), max_rows, seed, key)


def train_eval_split(
    df: DataFrame, eval_share: float, seed: int, key: str | list[str], tie: list[str] | None = None, together: bool = False,
) -> DataFrame:
    """All rows with a `split` of `train` or `eval`; eval has ceil(share · rows) of them.

    The key need not tell rows apart: of copies at the cut, a digest of the `tie` columns chooses, then one of all columns.
    With `together` all rows of a key are on one side, and eval may be larger by the copies at the cut.
    """
    drawn = _digest_of(df, key, seed, "split")
    cuts = _cuts(df.select(drawn.alias("drawn")), [], share=eval_share)
    if not cuts or together:
        chosen = (drawn <= cuts[0]["drawn"]) if cuts else F.lit(eval_share > 0)
        return df.withColumn("split", F.when(chosen, "eval").otherwise("train"))
    marked = _marked(df, drawn, cuts, [], seed, tie)
    mark = marked.columns[-1]
    return marked.withColumn("split", F.when(F.col(mark), "eval").otherwise("train")).drop(mark)


def head_n(df: DataFrame, n: int | None, order: str | list[str]) -> DataFrame:
    """The first n rows in the given order; 0 or None means all of them."""
    return df.orderBy(order).limit(n) if n else df
