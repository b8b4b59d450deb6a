"""Shards by a k-d tree over metadata, in DataFrame operations alone.

Each document is a point of its metadata, weighted by its bytes. A node of the tree is cut at the
weighted median (of m shards, at the share of floor(m / 2)) along the dimension in which its points
spread widest, until each leaf is one shard. Medians are found by histograms: bytes per bin of the
ordering key, then bins of the bin that holds the median, a few times; only the bins' sums are moved
and only one cut per node reaches the driver. The key ends in a hash, so that points that share a
coordinate (a source may hold a third of all rows) are cut as finely as any others.

Documents of equal text go to one shard, as one point, unless their group weighs more than the largest
document and more than GROUP_SHARE of a shard: sizes stay near equal, so such a group is spread like
single documents. Its rows may be equal in all columns: copies of a row are numbered, and the hash in the
key is of the number too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aislekit.session import written

SEED = 42
SHARDS = 40
#: Bytes that a row takes beside its text.
OVERHEAD = 16
#: A group of equal texts stays together up to this share of a shard's bytes, or the bytes of the largest document.
GROUP_SHARE = 0.02
#: Bits of a coordinate and of the hash in an ordering key; bits that one histogram resolves.
COORDINATE, TIE, STEP = 20, 32, 13
#: Parts of a shard in which its rows are numbered.
BUCKETS = 256
#: Bits of an increasing row id within which copies of a row are numbered together.
RUN = 16


def coordinate(column: str, kind: str) -> Column:
    """A number in the column's order: of texts the first six bytes, null before all."""
    c = F.col(f"`{column}`")
    if kind == "string":
        digits = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
        return F.coalesce(F.conv(digits, 16, 10).cast("double"), F.lit(-1.0))
    value = c.cast("double")
    return F.coalesce(F.when(F.isnan(value), None).otherwise(value), F.lit(-1.0))


def _points(df: DataFrame, key: str, text: str, dimensions: list[str], shards: int, seed: int) -> DataFrame:
    kinds = dict(df.dtypes)
    rows = df.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(text)).alias("g"),
        *[coordinate(d, kinds[d]).alias(f"d{i}") for i, d in enumerate(dimensions)])
    same = F.xxhash64(F.lit(seed), F.col("key"), F.col("g"), *[F.col(f"d{i}") for i in range(len(dimensions))])
    rows = written(rows.withColumns({"row": same, "id": F.monotonically_increasing_id()}), "kd-rows")
    firsts = [F.min(f"d{i}").alias(f"g{i}") for i in range(len(dimensions))]
    groups = rows.groupBy("g").agg(F.sum("size").alias("weight"), F.count("*").alias("n"), *firsts).where("n > 1").drop("n")
    total = rows.agg(F.sum("size").alias("all"), F.max("size").alias("largest")).first()
    groups = groups.where(F.col("weight") <= max((total["all"] or 0) / shards * GROUP_SHARE, total["largest"] or 0)).withColumn("together", F.lit(True))
    met = _copies_apart(rows).join(groups, "g", "left")
    tie = F.pmod(F.xxhash64(F.lit(seed + 1), F.coalesce(F.when(F.col("together"), F.col("g")), F.col("row"))), F.lit(1 << TIE))
    return written(met.select(
        "key", "size", "text_crc32", "row", F.lit(0).alias("node"), tie.alias("tie"),
        *[F.coalesce(F.col(f"g{i}"), F.col(f"d{i}")).alias(f"d{i}") for i in range(len(dimensions))]), "kd-points")


def _copies_apart(rows: DataFrame) -> DataFrame:
    """`row` made different for each copy of a row, by its number among them: in runs of rows, each starting after those before it."""
    rows = rows.withColumn("run", F.shiftright("id", RUN))
    ahead = Window.partitionBy("row").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("row", "run").agg(F.count("*").alias("n"))
    starts = starts.select("row", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("row", "run").orderBy("id")
    met = rows.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["row", "run"])
    copy = F.col("begin") + F.col("nth")
    return met.withColumn("row", F.when(copy > 0, F.xxhash64("row", copy)).otherwise(F.col("row"))).drop("id", "run", "nth", "begin")


def _small(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table with one row per node, of which there are at most as many as shards: small enough to broadcast."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*structs))))


_NODE = ["node", "dim", "low", "high"]


def _order(dimensions: int) -> Column:
    """The ordering key of a point in its node: coordinate within the node's range, then hash."""
    value = F.element_at(F.array(*[F.col(f"d{i}") for i in range(dimensions)]), F.col("dim") + 1)
    part = (value - F.col("low")) / (F.col("high") - F.col("low"))
    cell = F.when(F.col("high") > F.col("low"), F.floor(part * float((1 << COORDINATE) - 1))).otherwise(F.lit(0).cast("bigint"))
    return cell * F.lit(1 << TIE) + F.col("tie")


def _cuts(tree: DataFrame, nodes: list[tuple], leaves: list[int], weights: list[int], dimensions: int) -> list[int]:
    """For every node the key below which the share of its left child lies, nearest to it."""
    spark, bits = tree.sparkSession, COORDINATE + TIE
    start, before, after = [0] * len(leaves), [0] * len(leaves), list(weights)
    goal = [w * (m // 2) / m for w, m in zip(weights, leaves)]
    open_nodes = [i for i, m in enumerate(leaves) if m > 1 and weights[i]]
    while bits and any(after[i] - before[i] > weights[i] / leaves[i] / 1000 for i in open_nodes):
        step = min(STEP, bits)
        spec = _small(spark, [(*nodes[i], start[i], float(before[i]), goal[i]) for i in open_nodes], [*_NODE, "start", "before", "goal"])
        met = tree.join(spec, "node").withColumn("past", _order(dimensions) - F.col("start"))
        inside = met.where((F.col("past") >= 0) & (F.col("past") < F.lit(1 << bits)))
        bins = inside.groupBy("node", "before", "goal", F.shiftright("past", bits - step).alias("bin")).agg(F.sum("size").alias("w"))
        bins = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin")) + F.col("before"))
        bin_ = F.struct("bin", "w", "upto")
        hit = F.coalesce(F.min(F.when(F.col("upto") >= F.col("goal"), bin_)), F.max(bin_))
        bits -= step
        for r in bins.groupBy("node").agg(hit.alias("b")).collect():  # one row per node
            i, b = r["node"], r["b"]
            start[i] += b["bin"] << bits
            before[i], after[i] = b["upto"] - b["w"], b["upto"]
    return [s + (1 << bits if after[i] - goal[i] < goal[i] - before[i] else 0) for i, s in enumerate(start)]


def shard_tree(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text",
               dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), seed: int = SEED) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row; law `bytes`: sizes near equal.

    Null texts weigh the overhead alone. Null metadata come before all values. Repeated rows are rows of
    their own; the slot is a number within the shard, without gaps. Columns that are not named are not
    looked at; an empty table gives an empty one.
    """
    points, count = _points(df, key, text, list(dimensions), shards, seed), len(dimensions)
    edges = [f(f"d{i}").alias(f"{n}{i}") for i in range(count) for f, n in ((F.min, "low"), (F.max, "high"))]
    leaves, tree, wide = [shards], points, None
    while max(leaves) > 1:
        found = {r["node"]: r for r in tree.groupBy("node").agg(F.sum("size").alias("w"), *edges).collect()}  # one row per node
        if wide is None:
            wide = [max(found[0][f"high{i}"] - found[0][f"low{i}"], 1e-300) if found else 1 for i in range(count)]
        nodes = []
        for node in range(len(leaves)):
            r = found.get(node)
            widest = max(range(count), key=lambda i: (r[f"high{i}"] - r[f"low{i}"]) / wide[i]) if r else 0
            nodes.append((node, widest, r[f"low{widest}"], r[f"high{widest}"]) if r else (node, 0, 0.0, 0.0))
        cuts = _cuts(tree, nodes, leaves, [found[i]["w"] if i in found else 0 for i in range(len(leaves))], count)
        first, children = [], []
        for m in leaves:
            first.append(len(children))
            children += [m // 2, m - m // 2] if m > 1 else [m]
        spec = _small(tree.sparkSession, [(*n, c, m > 1, f) for n, c, m, f in zip(nodes, cuts, leaves, first)], [*_NODE, "cut", "split", "first"])
        met = tree.join(spec, "node")
        # written at every level, so that plans stay as small as one level
        tree = written(met.select(*[c for c in points.columns if c != "node"], (F.col("first") + F.when(F.col("split") & (_order(count) >= F.col("cut")), 1).otherwise(0)).alias("node")), "kd-level")
        leaves = children
    return _numbered(tree.select("key", "size", "text_crc32", "row", F.col("node").alias("shard"))).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _numbered(rows: DataFrame) -> DataFrame:
    """`slot`: rows are numbered within buckets of a shard, and each bucket starts after those before it."""
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("row", 16), F.lit(BUCKETS)))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("shard", "bucket").orderBy("row", "key")
    return rows.withColumn("nth", F.row_number().over(inside)).join(starts, ["shard", "bucket"]).withColumn(
        "slot", (F.col("begin") + F.col("nth") - 1).cast("bigint"))
