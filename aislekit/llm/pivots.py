"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points, the pivots, in order of nearness. Inverted lists
hold, for each label and pivot, the vectors that have the pivot among their first PREFIX. Two vectors are
candidates if they share SHARED of them at least; each such pair is looked at in one list alone, that of the
lowest pivot they share, and verified by cosine in double precision. Long lists are cut into parts, and parts
meet in pairs inside a task, which passes on the number of links of each vector and a spanning forest of the
links, never all pairs.

The number of pivots grows with the square root of the vectors, so a vector meets as many times more others
in its lists as it is compared with more pivots. Equal vectors of a label are one node, with their number as
its weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aislekit.llm.base import map_arrow
from aislekit.llm.components import components
from aislekit.session import written

#: Pivots are ROOTS times the square root of the nodes, within these bounds (and at most one for each vector of the
#: sample); they are chosen from a sample of SAMPLE vectors or SPARE for each pivot.
ROOTS, PIVOTS, MOST_PIVOTS = 4, 256, 8192
SAMPLE, SPARE = 4096, 8
#: Numbers that all pivots (beyond PIVOTS of them) and all vectors of the sample (beyond SAMPLE) have at most.
PIVOT_NUMBERS, SAMPLE_NUMBERS = 1 << 21, 1 << 22
#: Nearest pivots that describe a vector, and how many of them two near vectors share at least.
PREFIX, SHARED = 8, 3
#: Rows of a list that one task compares with as many others.
PART = 2048
SEED = 42


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Points of the sample that are far from each other, farthest first; fewer if the rest repeats them."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        far = int(nearest.argmin())
        if nearest[far] > 0.999999:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, sample @ sample[far])
    return sample[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """Numbers of the nearest pivots of each unit vector, nearest first; of equally near ones the lower first."""
    near = -(vectors @ pivots.T)
    if near.shape[1] <= prefix:
        return np.argsort(near, 1, kind="stable")
    # no pivot farther than the prefix-th is needed; ties with it are kept until the lower ones are taken
    bar = np.partition(near, prefix - 1, 1)[:, prefix - 1:prefix]
    row, pivot = np.nonzero(near <= bar)
    order = np.lexsort((pivot, near[row, pivot], row))
    row, pivot = row[order], pivot[order]
    return pivot[np.searchsorted(row, np.arange(len(near)))[:, None] + np.arange(prefix)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, scaled first so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _nodes(df: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row, node null for vectors that cannot link; (node, label, size, vector, weight) of each node."""
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("node", F.when(F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull(), F.xxhash64("label", "vector")))
    rows = written(rows, "pivot-rows")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("weight"))
    return rows.select("id", "node"), written(nodes.withColumn("size", F.size("vector")), "pivot-nodes")


def pivot_count(nodes: int, size: int) -> int:
    """Pivots for so many nodes of at most `size` numbers."""
    most = max(PIVOTS, min(MOST_PIVOTS, PIVOT_NUMBERS // max(size, 1)))
    return min(most, max(PIVOTS, int(ROOTS * nodes ** 0.5)))


def _pivot_sets(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots for each vector length in a bounded sample of the nodes."""
    total, widest = nodes.agg(F.count("*"), F.max("size")).first()
    count = pivot_count(total, widest or 1)
    wanted = min(max(SAMPLE, SPARE * count), max(SAMPLE, SAMPLE_NUMBERS // (widest or 1)))
    share = wanted / max(1, total)
    sample = nodes if share >= 1 else nodes.where(F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = sample.select("size", "vector", "node").sort("node").toArrow()  # about `wanted` rows
    sizes = np.asarray(rows.column("size").combine_chunks())
    return {size: choose_pivots(_unit(_matrix(rows.filter(pa.array(sizes == size)).column("vector"), size)), count) for size in np.unique(sizes).tolist()}


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.asarray(c.flatten(), np.float64).reshape(-1, size) for c in chunks])


def _lists(nodes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(label, size, pivot, node, weight, nearest, vector): a row for each list a node is in. Lengths that the
    sample has no vector of have one list."""
    kind = nodes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(1))
            for size in np.unique(sizes).tolist():
                rows = batch.filter(pa.array(sizes == size))
                vectors = _matrix(rows.column(3), size)
                near = nearest_pivots(_unit(vectors), pivots[size]) if size in pivots else np.zeros((len(vectors), 1), np.int64)
                ends = pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32())
                nearest = pa.ListArray.from_arrays(ends, pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, nearest], names=["label", "size", "node", "vector", "weight", "nearest"])

    described = map_arrow(
        nodes.select("label", "size", "node", "vector", "weight"), run,
        f"label {kind}, size int, node bigint, vector array<double>, weight bigint, nearest array<int>")
    return written(described, "pivot-lists").withColumn("pivot", F.explode("nearest"))


def linked(left, right, pivot: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of rows (nodes, weights, nearest pivots, vectors) that share enough pivots, `pivot` the lowest, and are near."""
    (_, _, a, x), (_, _, b, y) = left, right
    need = min(SHARED, a.shape[1])
    both = np.intersect1d(a, b)  # others cannot be shared

    def members(near: np.ndarray) -> np.ndarray:
        out = np.zeros((len(near), len(both) + 1), np.float32)
        at = np.minimum(np.searchsorted(both, near), len(both) - 1)
        np.put_along_axis(out, np.where(both[at] == near, at, len(both)), 1, 1)
        return out[:, :-1]

    in_a, in_b = members(a), members(b)
    shared = in_a @ in_b.T >= need
    lower = int(np.searchsorted(both, pivot))
    if lower:
        shared &= in_a[:, :lower] @ in_b[:, :lower].T == 0
    near = x @ y.T >= threshold
    return np.nonzero(shared & near)


def _forest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which links make a spanning forest, those of much linked rows first."""
    if len(i) == 0:
        return np.zeros(0, np.int64)
    degree = np.bincount(np.concatenate([i, j]))
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = up
        return v

    keep = []
    order = np.argsort(-np.maximum(degree[i], degree[j]), kind="stable")
    for e, v, w in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
        v, w = find(v), find(w)
        if v != w:
            root[v] = w
            keep.append(e)
    return np.array(keep, np.int64)


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: two vectors link if their labels are equal and not null,
    they have as many components, and their cosine is `threshold` at least.

    Vectors that are null, empty, all zero or hold a null or non-finite component link with nothing, and are their
    own component. Repeated rows are rows of their own. component_id is the smallest key that links reach; null
    keys are passed over. Other columns are not looked at; an empty table gives an empty one.
    """
    rows, nodes = _nodes(df, key, vector, label)
    lists = _lists(nodes, _pivot_sets(nodes))
    sizes = lists.groupBy("label", "size", "pivot").agg(F.count("*").alias("rows"))
    cut = lists.join(sizes, ["label", "size", "pivot"]).withColumn("parts", F.ceil(F.col("rows") / PART).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("node", "pivot"), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("label", "size", "pivot", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "weight", "nearest", "vector")

    def meet(table: pa.Table) -> pa.Table:
        p, q, pivot, size = (table.column(c)[0].as_py() for c in ("p", "q", "pivot", "size"))
        part, node, weight = (np.asarray(table.column(c)) for c in ("part", "node", "weight"))
        nearest = np.array(table.column("nearest").to_pylist())
        data = [node, weight, nearest, _unit(_matrix(table.column("vector"), size))]
        left = [x[part == p] for x in data]
        right = left if p == q else [x[part == q] for x in data]
        i = j = np.zeros(0, np.int64)
        if len(left[0]) and len(right[0]):
            i, j = linked(left, right, pivot, threshold)
            if p == q:
                i, j = i[i < j], j[i < j]
        gained = np.concatenate([np.bincount(i, right[1][j], len(left[0])), np.bincount(j, left[1][i], len(right[0]))]).astype(np.int64)
        ends = np.concatenate([left[0], right[0]])
        some = gained > 0
        # rows of the forest's links are numbered apart from those of the other part
        keep = _forest(i, j if p == q else j + len(left[0]))
        a, b = left[0][i[keep]], right[0][j[keep]]
        return pa.table({
            "a": pa.array(np.concatenate([ends[some], a]), pa.int64()),
            "b": pa.array(np.concatenate([np.zeros(some.sum(), np.int64), b]), pa.int64(), mask=np.arange(some.sum() + len(b)) < some.sum()),
            "links": pa.array(np.concatenate([gained[some], np.zeros(len(b), np.int64)]), pa.int64())})

    met = written(cut.groupBy("label", "size", "pivot", "p", "q").applyInArrow(meet, "a bigint, b bigint, links bigint"), "pivot-links")
    labels = components(met.where("b is not null").select("a", "b"))
    counted = met.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    known = nodes.select("node", "weight").join(counted, "node", "left").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = rows.join(known, "node", "left")
    least = placed.where("node is not null").groupBy("root").agg(F.min("id").alias("least"))
    out = placed.join(least, "root", "left").withColumn("component_id", F.when(F.col("node").isNotNull(), F.col("least")).otherwise(F.col("id")))
    return out.select(
        F.col("id").alias(key), F.when(F.col("node").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("n_links"),
        F.col("component_id").cast("bigint").alias("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
