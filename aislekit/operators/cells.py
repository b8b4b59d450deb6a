"""Reference cells: a partition of vectors by direction that bounds how near a vector of a cell can be to a query.

A sample of the vectors are references. A vector belongs to the cell of its nearest reference, and a cell knows
the smallest and the largest angle of its vectors to the reference. By the triangle inequality on angles, no vector of
a cell is nearer to a query than the query's angle to the reference lies outside of that range.

References are a bounded number of rows (MOST, and NUMBERS numbers in all), so they go to the driver and to every task.
Vectors of a length that no reference has, and zero vectors, make up a cell of their own for each length,
of number -length, about which nothing is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: References at most, and numbers of all of them together.
MOST, NUMBERS = 4096, 1 << 21
#: Cosines that are computed at once.
_STRIP = 1 << 20
#: Room for rounding in an angle.
_SLACK = 1e-6


def sound(vector):
    """Whether a vector is there, has numbers, and only finite ones."""
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)
    )


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, unit vectors) of the vectors of each length; a zero vector stays zero, a null one is left out."""
    sizes = np.asarray(pa.compute.fill_null(column.value_lengths(), 0))
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(rows)).flatten()
        matrix = np.array(flat.to_numpy(zero_copy_only=False), dtype="float64").reshape(len(rows), size)
        largest = np.maximum(matrix.max(axis=1), -matrix.min(axis=1))[:, None]
        np.divide(matrix, largest, out=matrix, where=largest > 0)
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
        yield size, rows, np.divide(matrix, norms, out=matrix, where=norms > 0)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


@dataclass(frozen=True)
class References:
    """The reference vectors by length: the numbers of their cells and the unit vectors."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray]]

    def nearest(self, size: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its angle to the reference, nan in a cell without one."""
        cell, angle = np.full(len(units), -size, np.int64), np.full(len(units), np.nan)
        if size in self.by_length:
            numbers, references = self.by_length[size]
            some = np.flatnonzero(units.any(axis=1))
            step = max(1, _STRIP // len(references))
            for s in range(0, len(some), step):
                at = some[s:s + step]
                cosines = units[at] @ references.T
                best = cosines.argmax(axis=1)
                cell[at] = numbers[best]
                angle[at] = _angles(cosines[np.arange(len(at)), best])
        return cell, angle


def references_of(vectors: DataFrame, key: str) -> References:
    """References for a table of vectors: some square root of their number, those of the lowest hash of their key."""
    some = vectors.where(sound(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    rows, size = some.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).collect()[0]
    wanted = max(1, min(int(rows ** 0.5), MOST, NUMBERS // size))
    drawn = some.orderBy(F.xxhash64(key), key).limit(wanted).select("embedding").toArrow()  # bounded, see NUMBERS
    by_length = {}
    for length, at, units in matrices(drawn.column("embedding").combine_chunks()):
        by_length[length] = at, units
    return References(by_length)


@dataclass(frozen=True)
class Cells:
    """References with what is known of their cells: `table` has rows (cell, low, high, rows) by cell."""

    references: References
    table: dict[int, tuple[float, float, int]]

    def bounds(self, size: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells that hold vectors of a length, and for each query the highest score a vector of each can have."""
        numbers, known = [], []
        if size in self.references.by_length:
            every, units_of = self.references.by_length[size]
            known = [i for i, c in enumerate(every.tolist()) if c in self.table]
            numbers = every[known].tolist()
        bound = np.zeros((len(units), len(numbers) + (-size in self.table)))
        if numbers:
            low, high = (np.array([self.table[c][i] for c in numbers]) for i in (0, 1))
            angle = _angles(units @ units_of[known].T)
            gap = np.maximum(np.maximum(angle - high, low - angle) - _SLACK, 0.0)
            bound[:, :len(numbers)] = np.cos(gap)
        if -size in self.table:
            bound[:, -1] = 1.0
            numbers = [*numbers, -size]
        bound[~units.any(axis=1)] = 0.0  # a zero vector scores nothing else
        return np.array(numbers, np.int64), bound

    def in_order(self) -> list[int]:
        """The cells, alike ones together: by the nearest of the first few references."""
        order = [c for c in self.table if c < 0]
        for numbers, units in self.references.by_length.values():
            few = units[:max(1, int(len(units) ** 0.5))]
            near = (units @ few.T).argmax(axis=1)
            order += [c for c in numbers[np.argsort(near, kind="stable")].tolist() if c in self.table]
        return order


def assigned(vectors: DataFrame, references: References) -> DataFrame:
    """The rows with `cell` and `angle`; null where the vector is not sound."""
    schema, columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema), vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            cell, angle, there = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            fine = np.asarray(batch.column("__sound"))
            for size, rows, units in matrices(pa.compute.if_else(batch.column("__sound"), column, pa.scalar(None, column.type))):
                rows, units = rows[fine[rows]], units[fine[rows]]
                cell[rows], angle[rows] = references.nearest(size, units)
                there[rows] = True
            yield pa.RecordBatch.from_arrays(
                [*batch.drop_columns(["__sound"]).columns, pa.array(cell, mask=~there), pa.array(angle, mask=~there | np.isnan(angle))],
                names=[*columns, "cell", "angle"])

    return vectors.withColumn("__sound", sound(F.col("embedding"))).mapInArrow(run, schema + ", cell bigint, angle double")


def cell_table(rows: DataFrame) -> DataFrame:
    """(cell, low, high, rows) of assigned rows."""
    return rows.where("cell IS NOT NULL").groupBy("cell").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("rows"))
