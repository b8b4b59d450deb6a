"""Exact nearest products by cosine, through a metric index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from aislekit import vocabulary as V
from aislekit.functions.text import number_text
from aislekit.operators.cells import Cells, assigned, matrices
from aislekit.session import fresh_path, written
from aislekit.sources.vectors import VectorStore, open_vectors, write_vectors

# Queries that a task compares at once.
CHUNK_ROWS = 1024
# Bytes of vectors on a shelf, and rows and bytes of queries that visit it in one task.
_SHELF_BYTES, _PART_ROWS, _PART_BYTES = 16 << 20, 1 << 16, 16 << 20
# Bounds that are looked at together, and bytes of vectors that go to shelves at once.
_BOUNDS, _SENT_BYTES = 1 << 17, 4 << 20
# Scores that one matrix product makes at most.
_STRIP = 1 << 20
# Room for rounding in the first look at a score; what passes it is computed again pair by pair.
_SLACK = 1e-9
_NEVER = float("-inf")


def search(
    queries: DataFrame, vectors: DataFrame | VectorStore, k: int = V.TOP_K, threshold: float | None = None,
    chunk_rows: int = CHUNK_ROWS, compared=None,
) -> DataFrame:
    """(query_id, product_id, score, rank): the k best products of each query, exactly.

    Vectors are stored by reference cell (see `operators.cells`); a table is stored first. Cells lie on shelves of bounded
    size. A query first visits its own cell and takes the k-th score there as its bar, then every shelf with cells
    that can hold a score that reaches the bar. Queries meet shelves in an equi-join, and k rows a query and shelf
    are ranked once more. Only references and cells reach the driver, which are bounded; no pair becomes a row.

    A zero vector scores 0.0; the lower id wins among equal scores. Vectors that are null, empty
    or hold a null or non-finite number take no part, nor do vectors of another length than the
    query. A score does not depend on the vectors beside it, nor on cells, shelves or chunk sizes.
    `compared`, a Spark accumulator, is told how many pairs are compared.
    """
    spark = queries.sparkSession
    store = vectors if isinstance(vectors, VectorStore) else _stored(vectors)
    kind = store.rows.schema["embedding"].dataType.elementType.simpleString()
    numbers = "float" if _is_float(queries) else "double"
    asked = queries.select(F.monotonically_increasing_id().alias("row"), "query_id", F.col("embedding").cast(f"array<{numbers}>").alias("embedding"))
    # a query's own cell is told once: near ties between references may fall differently in another batch
    asked = assigned(asked, store.cells.references).where("cell IS NOT NULL")
    asked = written(asked.select("row", "query_id", F.col("embedding").alias("vector"), F.col("cell").alias("home")), "asked")
    shelves = Shelves.of(store.cells, kind, int(spark.conf.get("spark.sql.shuffle.partitions")))
    longest, rows = asked.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)), F.count(F.lit(1))).collect()[0]
    each = longest * (4 if numbers == "float" else 8) + 16 * shelves.cells_each()
    parts = max(1, -(-rows // _PART_ROWS), -(-rows * each // _PART_BYTES))
    least = _NEVER if threshold is None else float(threshold)

    first = asked.withColumn("bar", F.lit(least))
    found = written(_meet(first, store, shelves, True, parts, k, chunk_rows, compared), "found-near")
    bars = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("reached")).where(F.col("n") >= k)
    bar = F.greatest(F.lit(least), F.coalesce("reached", F.lit(_NEVER)))
    second = asked.join(bars, "row", "left").select("row", "query_id", "vector", "home", bar.alias("bar"))
    rest = _meet(written(second, "asked-again"), store, shelves, False, parts, k, chunk_rows, compared)
    found = found.union(rest)
    if threshold is not None:
        found = found.where(F.col("score") >= threshold)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "product_id")
    ranked = found.select("query_id", "product_id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("score", F.round("score", 9))


def _is_float(df: DataFrame) -> bool:
    return df.schema["embedding"].dataType.simpleString() == "array<float>"


def _stored(vectors: DataFrame) -> VectorStore:
    path = fresh_path(vectors.sparkSession, "vectors")
    write_vectors(vectors.select("product_id", "embedding"), path, kind="float" if _is_float(vectors) else "double")
    return open_vectors(vectors.sparkSession, path)


@dataclass(frozen=True)
class Shelves:
    """Which shelves hold a cell's vectors: `spans` has the first one and their number; a vector's own is told by its id."""

    spans: dict[int, tuple[int, int]]

    @staticmethod
    def of(cells: Cells, kind: str, tasks: int) -> Shelves:
        """Alike cells side by side, on as many shelves as tasks, or as their bytes need."""
        total = sum(rows for _, _, rows in cells.table.values())
        longest = max([len(u[0]) for _, u in cells.references.by_length.values()] + [-c for c in cells.table if c < 0], default=1)
        room = max(1, min(_SHELF_BYTES // (longest * (4 if kind == "float" else 8)), max(4096, -(-total // tasks))))
        spans, before = {}, 0
        for cell in cells.in_order():
            rows = cells.table[cell][2]
            first, last = before // room, (before + rows - 1) // room
            spans[cell] = first, last - first + 1
            before += rows
        return Shelves(spans)

    def number(self) -> int:
        return max((first + n for first, n in self.spans.values()), default=1)

    def cells_each(self) -> int:
        """The cells on a shelf, on average."""
        return -(-sum(n for _, n in self.spans.values()) // self.number())

    def home(self, cell: int, row: int) -> int:
        """The one shelf of a cell that a query of this cell visits first."""
        first, n = self.spans[cell]
        return first + row % n


def _reached(batch: pa.RecordBatch, cells: Cells, shelves: Shelves, first: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of the batch, shelf, cell, bound) of the cells that queries visit, for a few queries at a time: as many as
    keep all bounds, and the vectors that go to all shelves, within their limits."""
    rows, bars, homes = (np.asarray(batch.column(c)) for c in ("row", "bar", "home"))
    for size, every, units in matrices(batch.column("vector")):
        step = max(1, min(_BOUNDS // (len(cells.table) + shelves.number()), _SENT_BYTES // (shelves.number() * size * 8)))
        for s in range(0, len(every), step):
            at = every[s:s + step]
            own = homes[at]
            home = np.array([shelves.home(c, r) if c in shelves.spans else -1 for c, r in zip(own.tolist(), rows[at].tolist())], np.int64)
            if first:
                some = home >= 0
                yield at[some], home[some], own[some], np.ones(int(some.sum()))
                continue
            numbers, bound = cells.bounds(size, units[s:s + step])
            i, c = np.nonzero(bound >= bars[at][:, None] - _SLACK)
            begin, n = np.array([shelves.spans[x] for x in numbers.tolist()], np.int64).reshape(-1, 2).T
            each = np.repeat(np.arange(len(i)), n[c])
            shelf = begin[c][each] + np.arange(len(each)) - np.repeat(np.cumsum(n[c]) - n[c], n[c])
            query, cell, high = i[each], numbers[c[each]], bound[i, c][each]
            some = (cell != own[query]) | (shelf != home[query])
            yield at[query[some]], shelf[some], cell[some], high[some]


def _wanted(asked: DataFrame, cells: Cells, shelves: Shelves, first: bool) -> list[int]:
    """The cells that any query visits."""
    def run(batches):
        for batch in batches:
            for _, _, cell, _ in _reached(batch, cells, shelves, first):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(cell), pa.int64())], names=["c"])

    return [r["c"] for r in asked.mapInArrow(run, "c bigint").distinct().collect()]  # no more than there are cells


def _visits(asked: DataFrame, cells: Cells, shelves: Shelves, first: bool) -> DataFrame:
    """(shelf, row, query_id, vector, bar, cells, bounds): the shelves each query visits, and there the cells that may
    reach its bar, with their bounds. In the first round that is its own cell on one shelf, in the second all others."""
    kinds = [asked.schema[c].dataType.simpleString() for c in ("query_id", "vector")]

    def run(batches):
        for batch in batches:
            for place, shelf, cell, bound in _reached(batch, cells, shelves, first):
                order = np.lexsort((shelf, place))
                place, shelf = place[order], shelf[order]
                begins = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(shelf) != 0)])) if len(order) else order
                ends = pa.array(np.append(begins, len(order)), pa.int32())
                some = batch.take(pa.array(place[begins], pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(shelf[begins], pa.int64()), *(some.column(c) for c in ("row", "query_id", "vector", "bar")),
                    pa.ListArray.from_arrays(ends, pa.array(cell[order], pa.int64())),
                    pa.ListArray.from_arrays(ends, pa.array(bound[order], pa.float64())),
                ], names=["shelf", "row", "query_id", "vector", "bar", "cells", "bounds"])

    return asked.mapInArrow(run, f"shelf bigint, row bigint, query_id {kinds[0]}, vector {kinds[1]}, bar double, cells array<bigint>, bounds array<double>")


def _meet(asked: DataFrame, store: VectorStore, shelves: Shelves, first_round: bool, parts: int, k: int, chunk_rows: int, compared) -> DataFrame:
    """(row, query_id, product_id, score): the k best of what each query finds on each shelf it visits; see `_visits`."""
    wanted = _wanted(asked, store.cells, shelves, first_round)
    visits = _visits(asked, store.cells, shelves, first_round)
    first = F.create_map(*[F.lit(v) for c in wanted for v in (c, shelves.spans[c][0])]) if wanted else None
    shelf_of = F.lit(0).cast("bigint")
    if wanted:
        spans = {c: n for c in wanted if (n := shelves.spans[c][1]) > 1}
        several = F.coalesce(F.create_map(*[F.lit(v) for item in spans.items() for v in item])[F.col("cell")], F.lit(1)) if spans else F.lit(1)
        shelf_of = first[F.col("cell")] + F.pmod(F.xxhash64("product_id"), several)
    offered = store.of_cells(wanted).select(shelf_of.cast("bigint").alias("shelf"), "cell", "product_id", F.col("embedding").alias("vector"))
    offered = offered.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    visits = visits.withColumn("part", F.pmod(F.col("row"), F.lit(parts)).cast("int"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((visits, "query_id"), (offered, "product_id"))]

    def run(asked: pa.Table, offered: pa.Table) -> pa.Table:
        found, pairs = nearest(asked, offered, k, chunk_rows)
        if compared is not None:
            compared.add(pairs)
        return found

    return visits.groupBy("shelf", "part").cogroup(offered.groupBy("shelf", "part")).applyInArrow(
        run, f"row bigint, query_id {kinds[0]}, product_id {kinds[1]}, score double")


def _best(query: np.ndarray, place: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Which of the rows are the k best of their query, by score and then by the order of the products."""
    by = np.lexsort((order[place], -score, query))
    begins = np.flatnonzero(np.concatenate([[True], np.diff(query[by]) != 0])) if len(by) else np.zeros(0, int)
    nth = np.arange(len(by)) - np.repeat(begins, np.diff(np.append(begins, len(by))))
    return by[nth < k]


def nearest(asked: pa.Table, offered: pa.Table, k: int, chunk_rows: int) -> tuple[pa.Table, int]:
    """The k best products of each query among the cells it wants, and the number of pairs compared.

    Cells are visited by falling bound, and a query leaves out those that its bar has risen above meanwhile.
    """
    compared, out = 0, []
    if asked.num_rows and offered.num_rows:
        offered = offered.combine_chunks()
        cell = np.asarray(offered.column("cell"))
        # the products' order, for equal scores
        order = np.asarray(pa.compute.rank(offered.column("product_id"), tiebreaker="dense"), np.int64)
        shelf: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for size, rows, units in matrices(offered.column("vector").combine_chunks()):
            by = np.argsort(cell[rows], kind="stable")
            rows, units = rows[by], units[by]
            begins = np.flatnonzero(np.concatenate([[True], np.diff(cell[rows]) != 0]))
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)]):
                shelf[int(cell[rows[a]])] = size, rows[a:b], units[a:b]
        for start in range(0, asked.num_rows, chunk_rows):
            chunk = asked.slice(start, chunk_rows).combine_chunks()
            bar = np.array(chunk.column("bar"), dtype="float64")
            lists = chunk.column("cells").combine_chunks()
            wanting = np.repeat(np.arange(chunk.num_rows), np.asarray(lists.value_lengths()))
            cells, bounds = np.asarray(lists.flatten()), np.asarray(chunk.column("bounds").combine_chunks().flatten())
            units = np.empty(chunk.num_rows, object)
            for _, rows, some in matrices(chunk.column("vector").combine_chunks()):
                units[rows] = list(some)
            best_query, best_place, best_score = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
            highest = {c: bounds[cells == c].max() for c in np.unique(cells).tolist() if c in shelf}
            for c in sorted(highest, key=lambda c: -highest[c]):
                size, places, candidates = shelf[c]
                here = cells == c
                query = wanting[here][bounds[here] >= bar[wanting[here]] - _SLACK]
                step = max(1, _STRIP // len(places))
                for s in range(0, len(query), step):
                    some = query[s:s + step]
                    wanted = np.stack(units[some])
                    compared += len(some) * len(places)
                    scores = wanted @ candidates.T
                    least = bar[some]
                    if len(places) > k:
                        least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                    i, j = np.nonzero(scores >= least[:, None] - _SLACK)
                    for b in range(0, len(i), _STRIP // size + 1):
                        x, y = i[b:b + _STRIP // size + 1], j[b:b + _STRIP // size + 1]
                        score = np.einsum("ij,ij->i", wanted[x], candidates[y])
                        keep = score >= bar[some[x]]
                        best_query = np.concatenate([best_query, some[x][keep]])
                        best_place = np.concatenate([best_place, places[y][keep]])
                        best_score = np.concatenate([best_score, score[keep]])
                    keep = _best(best_query, best_place, best_score, order, k)
                    best_query, best_place, best_score = best_query[keep], best_place[keep], best_score[keep]
                    full = np.bincount(best_query, minlength=len(bar)) >= k
                    lowest = np.full(len(bar), np.inf)
                    np.minimum.at(lowest, best_query, best_score)
                    bar = np.where(full, np.maximum(bar, lowest), bar)
            some = chunk.take(pa.array(best_query))
            out.append(pa.table({
                "row": some.column("row"), "query_id": some.column("query_id"),
                "product_id": offered.column("product_id").take(pa.array(best_place)), "score": pa.array(best_score)}))
    if out:
        return pa.concat_tables(out), compared
    empty = {"row": asked.schema.field("row").type, "query_id": asked.schema.field("query_id").type,
             "product_id": offered.schema.field("product_id").type, "score": pa.float64()}
    return pa.table({c: pa.array([], t) for c, t in empty.items()}), compared


def context_json(hits: DataFrame) -> DataFrame:
    """(query_id, product_context) from ranked product rows.

    Rows need query_id and rank beside the product fields; a query has at most k of them.
    A row whose product_id is null stands for a query without hits.
    """
    def fields(*names: str) -> Column:
        """The fields as in a JSON object, without its braces."""
        json = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
        return F.substring(json, F.lit(2), F.length(json) - 2)

    def number(name: str) -> Column:
        return F.concat(F.lit(f',"{name}":'), F.coalesce(number_text(F.col(name)), F.lit("null")))

    # `to_json` would write large and small numbers with an exponent
    product = F.concat(
        F.lit("{"), fields("product_id", "category", "title"), number("price"), F.lit(","), fields("brand", "features"),
        number("avg_rating"), F.lit("}"),
    )
    entry = F.when(F.col("product_id").isNotNull(), F.struct(F.col("rank"), product.alias("product")))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["product"])
    text = F.concat(F.lit(V.PRODUCTS_PREFIX + "["), F.array_join("listed", ","), F.lit("]"))
    return hits.groupBy("query_id").agg(listed.alias("listed")).select(
        "query_id",
        F.when(F.size("listed") == 0, F.lit(V.NO_PRODUCTS)).otherwise(text).alias("product_context"),
    )
